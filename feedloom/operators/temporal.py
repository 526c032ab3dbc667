"""Joins by time: the last row before, and the rows inside an interval.

* ``asof_join`` unites both sides, deals them by key and time range and carries the
  last value forward inside each range. What a range inherits is the last value
  of the ranges before it, one row per key and range. A key with many rows is cut
  in as many ranges as it needs, so no key has to fit in one task.
* ``interval_join`` deals intervals and points to bins of time. An interval takes
  the bin length of its own length class, so it lies in at most two bins however
  long it is; a point looks into one bin per class that occurs. It is an equi-join
  on (key, class, bin); the exact comparison follows, and each pair comes once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators import scale

# Rows of one key that one range of time should have.
RANGE_ROWS = 500_000


def _micros(name: str) -> Column:
    """Microseconds of a time, without a session's zone and its jumps."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(`{name}` AS TIMESTAMP_NTZ))")


def _struct(columns: list[str], name: str) -> Column:
    """A row as one value, so that its names clash with none."""
    return F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in columns]).alias(name)


def asof_join(
    left: DataFrame, right: DataFrame, key: str, time: str, order: str, prefix: str = "last_", range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Each left row with the right row of its key that is the latest before it.

    "Before" is a smaller ``time``, not an equal one; of right rows of equal time the
    one of the greatest ``order`` counts. The right columns get the ``prefix``; they
    are null where no row precedes, and in rows without a key or time.
    """
    names = [c for c in right.columns if c != key]
    mine = left.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(right.schema[order].dataType).alias("_o"),
                       _struct(left.columns, "_left"))
    told = right.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    told = told.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(1).alias("_side"), F.col(order).alias("_o"), _struct(names, "_right"))
    both = mine.unionByName(told, allowMissingColumns=True)
    # Ranges of a heavy key are bounded by quantiles of its times; any bounds give the result.
    heavy = scale.stage(both.groupBy("_k").agg(F.count("*").alias("_n")).where(F.col("_n") > range_rows))
    if heavy.isEmpty():
        both = both.withColumn("_range", F.lit(0))
    else:
        share = F.transform(F.sequence(F.lit(1), F.ceil(F.col("_n") / range_rows).cast("int") - 1), lambda i: i / F.ceil(F.col("_n") / range_rows))
        at = _micros("_t")
        few = scale.fits(heavy)
        timed = scale.keyed_join(both.select("_k", at.alias("_at")).where("_at IS NOT NULL"), heavy, ["_k"], ["_at"], small=few)
        sketch = timed.groupBy("_k").agg(F.percentile_approx("_at", [i / 64 for i in range(1, 64)], 10_000).alias("_cuts"), F.first("_n").alias("_n"))
        picked = F.transform(share, lambda s: F.get("_cuts", F.greatest(F.lit(0), F.least(F.lit(62), (s * 64).cast("int") - 1))))
        cuts = scale.stage(sketch.select("_k", F.array_distinct(picked).alias("_cuts")))
        both = both.join(F.broadcast(cuts) if scale.fits(cuts) else cuts, "_k", "left")
        both = both.withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda c: c < at)), F.lit(0))).drop("_cuts")
    # Left rows come before right rows of their time, so that equal times do not count.
    order_by = [F.col("_t").asc_nulls_first(), F.col("_side"), F.col("_o").asc_nulls_first()]
    before = Window.partitionBy("_k", "_range").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    carried = both.withColumn("_found", F.last("_right", ignorenulls=True).over(before))
    rows = carried.where("_side = 0")
    if not heavy.isEmpty():
        rank = F.struct("_t", "_o")
        ends = both.where("_side = 1").groupBy("_k", "_range").agg(F.max_by("_right", rank).alias("_end"))
        # One row per key and range: what the ranges after it inherit.
        all_ranges = both.select("_k", "_range").distinct().join(ends, ["_k", "_range"], "left")
        earlier = Window.partitionBy("_k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        inherited = scale.stage(all_ranges.withColumn("_end", F.last("_end", ignorenulls=True).over(earlier)).where("_end IS NOT NULL AND _range > 0"))
        few = scale.fits(inherited)
        rows = rows.join(F.broadcast(inherited) if few else inherited, ["_k", "_range"], "left").withColumn("_found", F.coalesce("_found", "_end"))
    found = F.when(F.col("_k").isNotNull() & F.col("_t").isNotNull(), F.col("_found"))
    out = rows.select("_left", found.alias("_found"))
    return out.select(*[F.col(f"_left.`{c}`") for c in left.columns], *[F.col(f"_found.`{c}`").alias(prefix + c) for c in names])


def interval_join(
    points: DataFrame, intervals: DataFrame, key: str | None, at: str, begin: str, end: str, base: int = 3_600_000_000
) -> DataFrame:
    """Each point with every interval of its key with begin <= at < end.

    Times are timestamps; ``key`` may be None. All columns of both sides are kept, so
    they must differ but for the key. ``base`` is the shortest bin, in microseconds.
    Points without a time, empty intervals and rows without a key meet nothing.
    """
    length = _micros(end) - _micros(begin)
    # Bins of class n are base * 4^n long; an interval is at most one bin long.
    size = F.greatest(F.lit(0), F.ceil(F.log(length / base) / F.log(F.lit(4.0)) - 1e-9)).cast("int")
    width = lambda c: F.lit(base).cast("bigint") * F.pow(F.lit(4.0), c).cast("bigint")
    spans = intervals.where(length > 0).withColumns({"_class": size, "_begin": _micros(begin), "_end": _micros(end)})
    # Rounding of the logarithm may choose a class too small: then the next one is taken.
    spans = spans.withColumn("_class", F.when(width(F.col("_class")) < F.col("_end") - F.col("_begin"), F.col("_class") + 1).otherwise(F.col("_class")))
    bins = F.sequence(F.floor(F.col("_begin") / width(F.col("_class"))), F.floor((F.col("_end") - 1) / width(F.col("_class"))))
    spans = spans.withColumn("_bin", F.explode(bins))
    # As many classes as powers of four between the shortest and the longest interval: a few.
    classes = spans.agg(F.sort_array(F.collect_set("_class")).alias("_classes"))
    asked = points.withColumn("_at", _micros(at)).where("_at IS NOT NULL").withColumn("_classes", classes.select("_classes").scalar())
    asked = asked.withColumn("_class", F.explode("_classes")).withColumn("_bin", F.floor(F.col("_at") / width(F.col("_class")))).drop("_classes")
    keys = [*([key] if key else []), "_class", "_bin"]
    joined = scale.keyed_join(asked, spans, keys, ["_at", *[c for c in points.columns if c != key]])
    return joined.where("_at >= _begin AND _at < _end").drop("_class", "_bin", "_at", "_begin", "_end")
