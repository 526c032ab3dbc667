"""Counts, sums and exact distinct counts for many sets of dimensions at once.

Rows are read once and put together at the finest level. Every coarser set is merged
from the smallest set above it that is already there, instead of repeating each row
for every set. Distinct numbers are kept as bitmaps, which merge without loss: one of
at most 4 KB for each group and range of 32,768 numbers that occurs in it. So a group
with very many numbers is spread over its ranges and never held by one task.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators import scale


def cube(dims: list[str]) -> list[tuple[str, ...]]:
    """Every set of the dimensions."""
    return [part for size in range(len(dims), -1, -1) for part in combinations(dims, size)]


def rollup(dims: list[str]) -> list[tuple[str, ...]]:
    """The first dimensions, one fewer each time."""
    return [tuple(dims[:size]) for size in range(len(dims), -1, -1)]


def grouping_sets(
    df: DataFrame, dims: list[str], sets: list[tuple[str, ...]], distinct: str, sums: dict[str, Column] | None = None, out: str = "distinct"
) -> DataFrame:
    """A row per group of each set: the dimensions, ``grouping_id``, ``n``, ``out`` and the sums.

    A dimension that is not in the set is null, and its bit of ``grouping_id`` is 1, the
    last dimension being the lowest bit; so nulls of the data are told apart. ``distinct``
    is a whole number; null ones are not counted. The empty set gives no row of an empty
    table, unlike SQL.
    """
    if unknown := {d for part in sets for d in part} - set(dims):
        raise ValueError(f"not dimensions: {sorted(unknown)}")
    sums = sums or {}
    number = F.col(distinct).cast("bigint")
    named = df.select(
        *dims, F.bitmap_bucket_number(number).alias("_range"), F.bitmap_bit_position(number).alias("_bit"),
        *[value.alias(f"_sum_{name}") for name, value in sums.items()],
    )
    added = [F.sum(f"_sum_{name}").alias(f"_sum_{name}") for name in sums]
    wanted = sorted({tuple(d for d in dims if d in part) for part in sets}, key=lambda part: (-len(part), part))
    finest = tuple(d for d in dims if any(d in part for part in wanted))
    base = named.groupBy(*finest, "_range").agg(F.count("*").alias("_n"), F.bitmap_construct_agg("_bit").alias("_bits"), *added)
    made = {finest: scale.stage(base)}
    for part in wanted:
        if part not in made:
            above = min((x for x in made if set(x) > set(part)), key=len)
            merged = made[above].groupBy(*part, "_range").agg(F.sum("_n").alias("_n"), F.bitmap_or_agg("_bits").alias("_bits"), *added)
            made[part] = scale.stage(merged)

    def told(part: tuple[str, ...]) -> DataFrame:
        group = made[part].groupBy(*part).agg(F.sum("_n").alias("n"), F.sum(F.bitmap_count("_bits")).alias(out), *added)
        kinds = dict(df.select(*dims).dtypes)
        own = [F.col(d) if d in part else F.lit(None).cast(kinds[d]).alias(d) for d in dims]
        id = sum(1 << k for k, d in enumerate(reversed(dims)) if d not in part)
        # Of no groups SQL's sum over nothing is one row; a set without rows has none here.
        rows = group if part else group.where("n IS NOT NULL")
        return rows.select(*own, F.lit(id).cast("bigint").alias("grouping_id"), "n", out, *[F.col(f"_sum_{x}").alias(x) for x in sums])

    return reduce(DataFrame.unionByName, [told(part) for part in wanted])
