"""Readers and writers. Schemas are declared, never inferred."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom import schemas
from feedloom.fixed_values import FEED_MAX_N, FEED_MIN_N
from feedloom.operators import scale

CSV_OPTIONS = {"header": "true", "escape": '"'}

# How characters that would end a CSV line, or start an escape, are written.
_ESCAPES = [("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")]


def read_table(spark: SparkSession, path: str, fmt: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """A table of a known schema from JSON lines, CSV, ORC or Parquet; columns
    the files lack are null.

    CSV is read as ``write_table`` writes it: one record per line, so that files
    are split over tasks. ``multiline`` reads values with line breaks of their
    own, a file per task.
    """
    reader = spark.read.schema(schema)
    if fmt != "csv":
        return reader.format(fmt).load(path)
    read = reader.options(**CSV_OPTIONS, multiLine=str(multiline).lower()).csv(path)
    return read if multiline else _texts(read, _unescaped)


def _texts(df: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    return df.select(
        *[change(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields]
    )


def _escaped(text: Column) -> Column:
    for char, written in _ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(written))
    return text


def _unescaped(text: Column) -> Column:
    """Reads escapes from the left: pieces between written backslashes hold the others."""
    pieces = F.split(text, r"\\\\")

    def plain(piece: Column) -> Column:
        for char, written in _ESCAPES[1:]:
            piece = F.replace(piece, F.lit(written), F.lit(char))
        return piece

    return F.array_join(F.transform(pieces, plain), "\\")


def load_stories(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Stories with their feed position; an absent title or url is null."""
    return read_table(spark, path, fmt, schemas.STORIES)


def load_feed(
    spark: SparkSession, ids_path: str, items_path: str, n: int, limit: int = FEED_MAX_N, ids_fmt: str = "array"
) -> DataFrame:
    """The first ``n`` stories of a feed, from its ids and a table of items.

    ``ids_fmt`` is "array" for the JSON array of one feed as it is served, one small
    file, or the format of a table of (id, feed_pos) of any size. ``n`` is held in the
    range of requests, ``limit`` being the longest head. The head is taken before the
    items are read; ids without an item keep a null title and url.
    """
    n = min(max(n, FEED_MIN_N), limit)
    if ids_fmt == "array":
        listed = F.slice(F.from_json("value", "array<bigint>"), 1, n)
        ids = spark.read.text(ids_path, wholetext=True).select(F.posexplode(listed).alias("_pos", "id"))
        head = ids.select("id", (F.col("_pos") + 1).cast("bigint").alias("feed_pos"))
    else:
        ids = read_table(spark, ids_path, ids_fmt, schemas.FEED_IDS)
        head = ids.where(F.col("feed_pos").between(1, n)).select("id", "feed_pos")
    items = read_table(spark, items_path, "json", schemas.STORY_ITEMS)
    # The head is counted and then broadcast, not the item table.
    found = scale.keyed_join(items, head.select("id").distinct(), ["id"], ["url"], how="left_semi")
    return head.join(found, "id", "left").select("id", "title", "url", "feed_pos")


def _flat(df: DataFrame) -> DataFrame:
    """CSV has no nested values: write them as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[
            F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def write_table(df: DataFrame, path: str, fmt: str, multiline: bool = False) -> None:
    """Write a table, replacing what was there: JSON lines with explicit nulls,
    CSV with a header and no index, or a columnar format. In CSV line breaks and
    backslashes of texts are escaped, unless ``multiline`` quotes them as they are."""
    if fmt == "json":
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    elif fmt == "csv":
        flat = _flat(df)
        (flat if multiline else _texts(flat, _escaped)).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)
