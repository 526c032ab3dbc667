"""What changed between two versions of a table.

Both versions go through one exchange as a union, each row marked with its side, and
are put together by a group-by: nulls in keys meet, no side is repeated for the other,
and repeated rows and hot keys are combined before the exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sides(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))


def bag_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows that are not as often in both versions, with ``n_old`` and ``n_new``."""
    columns = old.columns
    counted = _sides(old, new).groupBy(*columns).agg(F.count_if(~F.col("_new")).alias("n_old"), F.count_if("_new").alias("n_new"))
    return counted.where("n_old <> n_new")


def keyed_changes(old: DataFrame, new: DataFrame, keys: list[str], rank: str | None = None) -> DataFrame:
    """A row per key of either version: the keys, ``change``, the other columns of both
    versions as ``old`` and ``new`` (structs), ``n_old`` and ``n_new`` (rows of the key),
    and with ``rank`` how many places the key went up as ``moved``.

    ``change`` is added, removed, changed (another column differs), moved (only the rank
    does) or same; two nulls are the same. Where a key has several rows in a version,
    the least by its columns speaks for them and the numbers tell.
    """
    rest = [c for c in old.columns if c not in keys]
    row = F.struct(*rest)
    told = _sides(old, new).groupBy(*keys).agg(
        F.min(F.when(~F.col("_new"), row)).alias("old"), F.min(F.when(F.col("_new"), row)).alias("new"),
        F.count_if(~F.col("_new")).alias("n_old"), F.count_if("_new").alias("n_new"),
    )
    differ = F.lit(False)
    for c in rest:
        if c != rank:
            differ = differ | ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    change = F.when(F.col("n_old") == 0, "added").when(F.col("n_new") == 0, "removed").when(differ, "changed")
    if rank:
        change = change.when(~F.col(f"old.{rank}").eqNullSafe(F.col(f"new.{rank}")), "moved")
        told = told.withColumn("moved", F.col(f"old.{rank}") - F.col(f"new.{rank}"))
    return told.withColumn("change", change.otherwise("same"))
