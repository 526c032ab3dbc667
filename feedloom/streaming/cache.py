"""Keep the text cache up to date as fetched pages arrive.

The cache outlives a request: a url seen once is never processed again. Here
pages arrive as a stream and each micro-batch adds the urls the cache lacks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom import schemas
from feedloom.operators import corpus, reuse


def refresh_text_cache(pages: DataFrame, cache_path: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """Start a query that appends new urls of ``pages`` to the Parquet cache.

    ``pages``: url, status, html, error and the ``order`` columns. Unusable
    pages are stored with an empty text. The query stops when all available
    input is read. A batch that is run again after a failure finds its urls in
    the cache and appends nothing twice.
    """
    spark = pages.sparkSession
    spark.createDataFrame([], schemas.TEXT_CACHE).write.mode("append").parquet(cache_path)

    def append_new(batch: DataFrame, _batch_id: int) -> None:
        session = batch.sparkSession
        cache = session.read.schema(schemas.TEXT_CACHE).parquet(cache_path)
        arrived = reuse.with_key(batch, "url", "url_key")
        fresh = reuse.dedupe_by_key(reuse.new_only(arrived, cache, "url_key", order), "url_key", order)
        texts = fresh.transform(corpus.extract_text).transform(corpus.resolve_fetch)
        texts.select("url_key", F.coalesce("text", F.lit("")).alias("text")).write.mode("append").parquet(cache_path)

    return (
        pages.writeStream.foreachBatch(append_new)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
