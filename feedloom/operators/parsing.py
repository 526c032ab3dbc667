"""From generator output to the list of queries in it.

``enable`` must have run on the session: a repeated JSON key then means its
last value, and not an unreadable document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.fixed_values import PARSE_FAILURE_PREFIX
from feedloom.functions import responses as rx
from feedloom.functions.binding import bind


def enable(spark: SparkSession) -> None:
    """Let the last of repeated JSON keys win, in this session."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def slice_json(df: DataFrame, close: str = "first", response: str = "response", out: str = "slice") -> DataFrame:
    """Add the span that should hold the JSON object."""
    return df.withColumn(out, rx.json_slice(F.col(response), close))


def parse_queries(
    df: DataFrame,
    on_fail: str = "marker",
    normalise: bool = True,
    sliced: str = "slice",
    out: str = "output",
) -> DataFrame:
    """Add the queries of each slice, and ``parsed``: whether it was readable.

    With ``normalise`` the slice must be a JSON object whose ``queries`` is a
    list of strings; they are lower-cased, de-duplicated and sorted. Without,
    any JSON object is readable and its queries are kept as they are; an
    object without a list of queries gives null.

    An unreadable slice gives null (``on_fail="null"``), an empty list
    (``"empty"``) or a one-element list with the failure text (``"marker"``).
    """
    enable(df.sparkSession)
    document = rx.json_document(F.col(sliced))
    if normalise:
        read = bind(rx.string_list(document, "queries"), lambda queries: _read(queries.isNotNull(), rx.normalised(queries)))
    else:
        read = bind(
            document, lambda found: _read(found.isNotNull(), F.try_variant_get(found, "$.queries", "array<string>"))
        )
    failed = {
        "null": F.lit(None).cast("array<string>"),
        "empty": F.array().cast("array<string>"),
        "marker": F.array(F.concat(F.lit(PARSE_FAILURE_PREFIX), F.col(sliced))),
    }[on_fail]
    return (
        df.withColumn("_read", read)
        .withColumn("parsed", F.col("_read.readable"))
        .withColumn(out, F.when(F.col("_read.readable"), F.col("_read.queries")).otherwise(failed))
        .drop("_read")
    )


def _read(readable: Column, queries: Column) -> Column:
    return F.struct(readable.alias("readable"), queries.alias("queries"))


def explode_outputs(df: DataFrame, output: str = "output", number: str = "version", query: str = "query") -> DataFrame:
    """One row per element of the output, numbered from 1.

    The outer form and the filter after it give the rows of the plain form, but
    spare the planner's own filter, which would parse every response again.
    """
    others = [c for c in df.columns if c != output]
    return (
        df.select(*others, F.posexplode_outer(output).alias("_n", query))
        .where(F.col("_n").isNotNull())
        .select(*others, (F.col("_n") + 1).cast("bigint").alias(number), query)
    )
