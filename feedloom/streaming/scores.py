"""Score stories as they arrive, each url once, and set late ones aside.

Stories are embedded where they are read; only their vectors meet the state that
knows the urls of the last ``delay``. Profiles are a static table that shares a key
with the stories (a language, a feed): an equi-join per micro-batch. Scores go to a
Parquet sink, which counts each micro-batch once however often it is tried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.operators import reuse, scale, similarity
from feedloom.operators.embedding import Embedder, embed


def score_arriving(
    stories: DataFrame,
    profiles: DataFrame,
    key: str,
    time: str,
    delay: str,
    text: str = "text",
    embedder: Embedder | None = None,
) -> DataFrame:
    """(profile_id, key, score and the columns of the stories but the text).

    ``stories``: a stream with url, ``key``, ``time`` and ``text``; ``profiles``:
    profile_id, ``key`` and vec. A url seen within ``delay`` is not scored again;
    rows older than the watermark are left out, see ``set_aside``. Without an
    embedder of their own, texts are embedded before urls are compared, as
    that costs less than moving them; a plugged-in model sees each url once.
    """
    def once(rows: DataFrame) -> DataFrame:
        keyed = reuse.with_key(rows, "url", "url_key").where(F.col("url_key").isNotNull())
        return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["url_key"])

    def vectors(rows: DataFrame) -> DataFrame:
        return embed(rows, text, "vec", embedder).drop(text)

    items = vectors(once(stories)) if embedder else once(vectors(stories))
    asked = profiles.select("profile_id", key, "vec")
    # Counted: few profiles reach every task, many are shuffled by key.
    return similarity.score_static(items, F.broadcast(asked) if scale.fits(asked) else asked, key)


def set_aside(rows: DataFrame, until: Column, time: str, delay: str, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that appends rows that come too late to ``path``.

    A row is late if ``until`` (its time, or the end of its window) is not after
    the watermark: the greatest ``time`` of former micro-batches less ``delay``,
    as stateful operators of the same batches have it. The greatest time of each
    micro-batch is one row beside the late rows; a micro-batch that runs again
    writes both again in place.
    """
    spark = rows.sparkSession

    def split(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        latest = f"{path}/latest"
        former = session.read.schema("at timestamp, batch bigint").parquet(latest).where(F.col("batch") < number)
        greatest = former.agg(F.max("at").alias("at")).select(F.date_trunc("millisecond", "at") - F.expr(f"interval {delay}"))
        late = batch.withColumn("_watermark", greatest.scalar()).where(until <= F.col("_watermark")).drop("_watermark")
        late.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        batch.agg(F.max(time).alias("at")).write.mode("overwrite").parquet(f"{latest}/batch={number}")

    spark.createDataFrame([], "at timestamp").write.mode("overwrite").parquet(f"{path}/latest/batch=-1")
    return rows.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(path: str, like: DataFrame) -> DataFrame:
    """What ``set_aside`` has put aside."""
    return like.sparkSession.read.schema(like.schema).option("recursiveFileLookup", "true").parquet(f"{path}/rows")


def append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that appends a stream to ``path`` until the input is read to its end."""
    sink = rows.writeStream.format("parquet").outputMode("append").option("path", path)
    return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(arrivals: DataFrame, batches: int, folder: str, runs: Callable[[DataFrame], list[StreamingQuery]]) -> None:
    """Deliver a table as a stream: the rows of ``batch`` 0, 1, ... are written one
    after the other, and after each the queries read what there is to its end."""
    spark, columns = arrivals.sparkSession, [c for c in arrivals.columns if c != "batch"]
    arrivals = scale.stage(arrivals)
    for number in range(batches):
        arrivals.where(F.col("batch") == number).select(*columns).write.mode("append").parquet(folder)
        for query in runs(spark.readStream.schema(arrivals.select(*columns).schema).parquet(folder)):
            query.awaitTermination()
