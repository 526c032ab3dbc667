"""Statistics of a stream by event time, in tumbling and in session windows.

The state of an open window is its count, mean and sum of squared deviations (M2),
which merge with those of later rows. A window leaves the state when the
watermark passes its end; rows of windows that have left come too late and are
dropped (``scores.set_aside`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = ["n", "mean", "m2", "least", "most"]


def _grouped(events: DataFrame, window: Column, keys: list[str], value: str, time: str, delay: str) -> DataFrame:
    found = events.withWatermark(time, delay).groupBy(*keys, window.alias("_window")).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"),
        F.min(value).alias("least"), F.max(value).alias("most"),
    )
    return found.select(*keys, F.col("_window.start").alias("start"), F.col("_window.end").alias("end"), *STATS)


def tumbling(events: DataFrame, keys: list[str], value: str, time: str, size: str, delay: str) -> DataFrame:
    """n, mean, m2, least and most of ``value`` per key and window of ``size``."""
    return _grouped(events, F.window(time, size), keys, value, time, delay)


def sessions(events: DataFrame, keys: list[str], value: str, time: str, gap: str, delay: str) -> DataFrame:
    """The same per run of events of a key that follow each other within ``gap``."""
    return _grouped(events, F.session_window(time, gap), keys, value, time, delay)


def merged(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of several windows as one per ``keys``; no event is read again.

    The mean of means is weighted by counts; squared deviations are those inside
    the windows and those of their means.
    """
    n = F.sum("n").alias("n")
    mean = F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("mean")
    whole = stats.groupBy(*keys).agg(n, mean)
    renamed = whole.select(*keys, F.col("mean").alias("_mean"))
    apart = F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    renamed = renamed.select(*[F.col(k).alias(f"_{k}") for k in keys], "_mean")
    spread = stats.join(renamed, same).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum(apart).alias("m2"), F.min("least").alias("least"), F.max("most").alias("most")
    )
    return spread.select(*keys, *STATS)
