"""Content-addressed reuse: work is done once per distinct url or text.

The cache is a table. A key whose text is empty is known to be bad and is not
tried again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import content_key
from feedloom.operators import scale
from feedloom.operators.embedding import Embedder, TokenCountEmbedder


# A joined row may hold a text of the longest allowed length.
TEXT_BYTES = 200_000


def with_key(df: DataFrame, col: str, out: str) -> DataFrame:
    """Add the content key of a column."""
    return df.withColumn(out, content_key(F.col(col)))


def dedupe_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row per key in ``order``. Rows without a key have nothing to
    share and are left out: see ``keyless``.

    ``min_by`` combines map-side, so a task ships one row per key it saw and a
    hot key costs no more than any other.
    """
    rest = [c for c in df.columns if c != key]
    # A struct is never null, so rows whose order is null come last, not nowhere.
    place = F.struct(*[part for c in order for part in (F.col(c).isNull(), F.col(c))])
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min_by(F.struct(*rest), place).alias("_first"))
        .select(key, "_first.*")
        .select(df.columns)
    )


def keyless(df: DataFrame, key: str) -> DataFrame:
    """The rows that ``dedupe_by_key`` leaves out."""
    return df.where(F.col(key).isNull())


def new_only(
    df: DataFrame, cache: DataFrame, key: str, spread_by: list[str], broadcast_rows: int = scale.BROADCAST_ROWS
) -> DataFrame:
    """Rows whose key the cache does not know; rows without a key are no work.

    ``cache`` has one row per key; its key column alone is read. A small cache
    is broadcast; for a small batch the cache is only scanned for the batch's
    keys; two large sides are shuffled, hot keys salted.
    """
    keyed, known = df.where(F.col(key).isNotNull()), cache.select(key)
    small = scale.fits(known, broadcast_rows)
    if not small and scale.fits(keyed, broadcast_rows):
        known = known.join(F.broadcast(keyed.select(key).distinct()), key, "left_semi")
        small = True
    return scale.keyed_join(keyed, known, [key], spread_by, how="left_anti", small=small).select(df.columns)


def extend_cache(cache: DataFrame, found: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows to append to the cache: the first of each key it does not know.

    What the cache knows is dropped before rows of one key are compared, so the
    wide columns of known keys are neither sorted nor combined.
    """
    return dedupe_by_key(new_only(found, cache, key, order), key, order).select(cache.columns)


def embed_distinct(
    df: DataFrame,
    id_cols: list[str],
    text: str = "text",
    out: str = "vec",
    embedder: Embedder | None = None,
    cache_path: str | None = None,
) -> DataFrame:
    """``id_cols`` and vector of every row, each distinct text embedded once.

    The text crosses the network once, after map-side de-duplication; going
    back to the rows, only keys and vectors move. Row keys and vectors are
    staged so that the texts are neither read nor embedded again. With a
    ``cache_path`` the vectors are kept there for later runs, and only texts
    the cache does not know are embedded.
    """
    embedder = embedder or TokenCountEmbedder()
    keyed = df.select(*id_cols, content_key(F.col(text)).alias("text_key"), F.col(text).alias("_text"))
    distinct = keyed.where(F.col("_text").isNotNull()).select("text_key", "_text").dropDuplicates(["text_key"])
    if cache_path is None:
        vectors = scale.stage(embedder.embed(distinct, "_text", out).select("text_key", out))
    else:
        vectors = _refreshed_vectors(distinct, out, embedder, cache_path)
    rows = scale.stage(keyed.select(*id_cols, "text_key"))
    return scale.keyed_join(rows, vectors, ["text_key"], id_cols, how="left").select(*id_cols, out)


def _refreshed_vectors(texts: DataFrame, out: str, embedder: Embedder, path: str) -> DataFrame:
    """The vector cache after the texts it lacked were embedded and appended.

    A run that is repeated after a failure finds what was appended before it.
    """
    spark = texts.sparkSession
    embedded = embedder.embed(texts, "_text", out).select("text_key", out)
    spark.createDataFrame([], embedded.schema).write.mode("append").parquet(path)
    cache = spark.read.schema(embedded.schema).parquet(path)
    fresh = new_only(texts, cache, "text_key", ["text_key"])
    embedder.embed(fresh, "_text", out).select("text_key", out).write.mode("append").parquet(path)
    return spark.read.schema(embedded.schema).parquet(path)


def cached_text(df: DataFrame, cache: DataFrame, spread_by: list[str], url: str = "url", out: str = "text") -> DataFrame:
    """Add the cached text of each url; null without a url, for unknown urls
    and for urls known to be bad. Texts are wide, so the cache is not broadcast."""
    known = cache.select(F.col("url_key").alias("_key"), F.when(F.col("text") != "", F.col("text")).alias(out))
    keyed = with_key(df, url, "_key")
    return scale.keyed_join(keyed, known, ["_key"], spread_by, how="left", small=False, row_bytes=TEXT_BYTES).drop("_key")
