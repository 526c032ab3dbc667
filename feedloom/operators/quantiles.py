"""Exact quantiles per group without sorting the groups.

Sketches give, per group, a narrow bracket around each wanted order statistic:
the rows of a group are dealt over shards, each shard is sketched by itself, and
the bracket runs from the least to the greatest of the shards' bounds. One counting pass proves how many values lie below each bracket and that the
bracket holds the statistic; only the values inside the brackets are sorted. A
bracket that fails its proof is replaced by the whole range, so the result is
exact whatever the sketch returned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators import scale

# A sketch is off by at most N / ACCURACY ranks; brackets allow ten times that.
# Its size grows with ACCURACY and one arrives per input task, so a group's
# sketches are merged in SHARDS tasks. Up to 128 sketches (groups x shards) a
# task aggregates by hashing, beyond that it sorts.
ACCURACY = 1_000
MARGIN = 10 / ACCURACY
SHARDS = 16


def _place(n: Column, p: float, method: str) -> Column:
    """0-based fractional place of quantile ``p`` among ``n`` sorted values."""
    if method == "plotly":
        place = F.lit(p) * n - F.lit(0.5)
    elif method == "linear":
        place = F.lit(p) * (n - 1)
    else:
        raise ValueError(f"unknown method {method!r}")
    return F.least(F.greatest(place, F.lit(0.0)), (n - 1).cast("double"))


def exact_quantiles(
    df: DataFrame,
    by: str,
    value: str,
    quantiles: dict[str, float],
    row_id: list[str],
    method: str = "plotly",
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per group: ``n`` and each named quantile."""
    return counted_quantiles(df, by, value, quantiles, row_id, method, accuracy)[0]


def counted_quantiles(
    df: DataFrame,
    by: str,
    value: str,
    quantiles: dict[str, float],
    row_id: list[str],
    method: str = "plotly",
    accuracy: int = ACCURACY,
) -> tuple[DataFrame, bool]:
    """The quantiles, and whether the groups were counted few enough to broadcast.

    ``row_id`` tells the rows of a group apart, so that equal values can be
    dealt to several tasks. ``method`` "plotly" interpolates at p*n - 0.5, "linear" at p*(n-1). Null
    groups and null values are left out.
    """
    rows = df.where(F.col(by).isNotNull() & F.col(value).isNotNull()).select(
        by, *row_id, F.col(value).cast("double").alias("_value")
    )
    names, probs = list(quantiles), list(quantiles.values())

    probes = [max(p - MARGIN, 0.0) for p in probs] + [min(p + MARGIN, 1.0) for p in probs]
    sketched = (
        rows.groupBy(by, F.pmod(F.xxhash64(*row_id), F.lit(SHARDS)).alias("_shard"))
        .agg(F.count("*").alias("_rows"), F.percentile_approx("_value", probes, accuracy).alias("_probe"))
        .groupBy(by)
        .agg(
            F.sum("_rows").alias("n"),
            *[F.min(F.get("_probe", F.lit(i))).alias(f"_low{i}") for i in range(len(probs))],
            *[F.max(F.get("_probe", F.lit(i + len(probs)))).alias(f"_high{i}") for i in range(len(probs))],
        )
    )
    edges = scale.stage(
        sketched.select("*", *[_place(F.col("n"), p, method).alias(f"_place{i}") for i, p in enumerate(probs)])
    )
    few = scale.fits(edges)

    counted = (
        scale.keyed_join(rows, edges, [by], row_id, small=few)
        .groupBy(by)
        .agg(
            *[F.count_if(F.col("_value") < F.col(f"_low{i}")).alias(f"_below{i}") for i in range(len(probs))],
            *[F.count_if(F.col("_value") <= F.col(f"_high{i}")).alias(f"_upto{i}") for i in range(len(probs))],
        )
        .join(edges, by)
    )

    def proved(i: int) -> Column:
        at = F.floor(f"_place{i}")
        return (F.col(f"_below{i}") <= at) & (F.col(f"_upto{i}") >= F.least(at + 2, F.col("n")))

    figures = []
    for i in range(len(probs)):
        figures += [
            F.col(f"_place{i}"),
            F.when(proved(i), F.col(f"_low{i}")).otherwise(F.lit(float("-inf"))).alias(f"_low{i}"),
            F.when(proved(i), F.col(f"_high{i}")).otherwise(F.lit(float("inf"))).alias(f"_high{i}"),
            F.when(proved(i), F.col(f"_below{i}")).otherwise(F.lit(0).cast("bigint")).alias(f"_below{i}"),
        ]
    brackets = scale.stage(counted.select(by, "n", *figures))

    # A bracket of one value is that value: ties, however many, are not sorted.
    def open_at(i: int) -> Column:
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        return (low < high) & F.col("_value").between(low, high)

    hits = [
        F.when(open_at(i), F.struct(F.lit(i).alias("i"), F.col(f"_below{i}").alias("below"), F.col(f"_place{i}").alias("place")))
        for i in range(len(probs))
    ]
    inside = (
        scale.keyed_join(rows, brackets, [by], row_id, small=few)
        .where(reduce(lambda a, b: a | b, [open_at(i) for i in range(len(probs))]))
        .select(by, *row_id, "_value", F.explode(F.array_compact(F.array(*hits))).alias("_b"))
        .select(by, *row_id, "_value", F.col("_b.i").alias("_i"), F.col("_b.below").alias("_below"), F.col("_b.place").alias("_place"))
    )
    order = [F.col("_value"), *map(F.col, row_id)]
    placed = scale.ordered_positions(scale.stage(inside), order, by=[by, "_i"], out="_rank", few_groups=few)
    index = F.col("_below") + F.col("_rank") - 1
    low, part = F.floor("_place"), F.col("_place") - F.floor("_place")
    weight = F.when(index == low, 1 - part).when((index == low + 1) & (part > 0), part)
    picked = placed.withColumn("_weight", weight).where(F.col("_weight").isNotNull())
    sums = picked.groupBy(by).agg(
        *[F.sum(F.when(F.col("_i") == i, F.col("_value") * F.col("_weight"))).alias(f"_sum{i}") for i in range(len(probs))]
    )
    found = brackets.join(sums, by, "left").select(
        by,
        "n",
        *[
            F.when(F.col(f"_low{i}") == F.col(f"_high{i}"), F.col(f"_low{i}")).otherwise(F.col(f"_sum{i}")).alias(name)
            for i, name in enumerate(names)
        ],
    )
    return found, few
