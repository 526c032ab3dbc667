"""Statistics and box plots of runs kept up to date, without reading old runs.

A batch of runs leaves two tables under its name. ``values`` holds each different
value of a measure with its number, by (model, measure, cell); ``cells`` one row per
cell: number, mean above the least value, sum of squared deviations, least and
greatest value. A cell is a range of values that differ by at most 1/CELLS_PER_OCTAVE
of an octave, so a model has a bounded number of them, however many runs it has.

Statistics are merged from the cells alone. An order statistic is found in two steps:
counts of cells tell which cell holds it and at which place, then only the values of
that cell are read and counted in order. Whiskers and outliers need the cells of
their two fences. All are exact.

Adding is safe to repeat: a batch of the same name replaces the earlier one, and its
cells, written last, are what makes it visible. Missing and NaN values are left out,
as are rows without a model. Batches without any value leave no trace.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.operators import scale
from feedloom.operators.evaluation import MEASURES, missing_as_null

CELLS_PER_OCTAVE = 32
# Doubles have 2098 octaves; beyond lies infinity.
_OCTAVES = 1100
KEYS = ["model", "measure"]
_VALUES = "model string, measure string, cell bigint, value double, n bigint, batch string"
_CELLS = "model string, measure string, cell bigint, n bigint, above double, m2 double, low double, high double, batch string"


def cell_of(value: Column) -> Column:
    """The cell of a number; greater numbers have no lesser cell."""
    octave = F.greatest(F.least(F.log2(F.abs(value)), F.lit(_OCTAVES)), F.lit(-_OCTAVES))
    size = (F.floor(octave * CELLS_PER_OCTAVE) + (_OCTAVES + 1) * CELLS_PER_OCTAVE).cast("bigint")
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0).cast("bigint"))


def _folder(path: str, table: str, batch: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError(f"a batch is named by letters, digits, '_', '.' and '-', not {batch!r}")
    return f"{path}/{table}/batch={batch}"


def add_batch(runs: DataFrame, path: str, batch: str, model: str = "model", measures: tuple[str, ...] = MEASURES) -> None:
    """Add a batch of runs to the tables at ``path``, or replace the one of that name."""
    spark = runs.sparkSession
    told = missing_as_null(runs, measures).where(F.col(model).isNotNull())
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]))
    rows = told.select(F.col(model).cast("string").alias("model"), each.alias("_m")).select("model", "_m.*").where("value IS NOT NULL")
    # Both zeros are one value, and equal values one row: a hot value is counted map-side.
    counted = rows.withColumn("value", F.col("value") + F.lit(0.0)).groupBy(*KEYS, "value").agg(F.count("*").alias("n"))
    values = counted.select(*KEYS, cell_of(F.col("value")).alias("cell"), "value", "n")
    # Sorted, so that reading one cell of a model skips what lies elsewhere.
    order = [*KEYS, "cell", "value"]
    values.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(_folder(path, "values", batch))
    written = spark.read.schema(values.schema).parquet(_folder(path, "values", batch))
    each = {"above": F.lit(0.0), "m2": F.lit(0.0), "low": F.col("value"), "high": F.col("value")}
    cells = _merged(written.withColumns(each), [*KEYS, "cell"])
    cells.coalesce(1).write.mode("overwrite").parquet(_folder(path, "cells", batch))


def _merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Partials of the same keys as one. All is reckoned from the least value of the
    group: from zero, close values of great size would lose their differences."""
    near = parts.groupBy(*by).agg(F.min("low").alias("_near"))
    apart, whole = F.col("above") + (F.col("low") - F.col("_near")), F.sum("n")
    above = F.sum(F.col("n") * apart) / whole
    squares = F.sum(F.col("m2") + F.col("n") * apart * apart) - whole * above * above
    return parts.join(near, by).groupBy(*by).agg(
        whole.alias("n"), above.alias("above"), F.greatest(squares, F.lit(0.0)).alias("m2"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of all batches; one row per (model, measure, cell)."""
    parts = spark.read.schema(_CELLS).parquet(f"{path}/cells")
    return _merged(parts.drop("batch"), [*KEYS, "cell"])


def stats(spark: SparkSession, path: str, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """``evaluation.model_stats`` of all batches, from their cells alone."""
    parts = spark.read.schema(_CELLS).parquet(f"{path}/cells").drop("batch")
    told = _merged(parts, KEYS).withColumn("mean", F.col("low") + F.col("above"))
    told = told.withColumn("std", F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))))

    def of(measure: str, column: str) -> Column:
        return F.max(F.when(F.col("measure") == measure, F.col(column)))

    named = [("mean", "mean"), ("std", "std"), ("min", "low"), ("max", "high")]
    return told.groupBy("model").agg(*[of(m, c).alias(f"{m}_{s}") for m in measures for s, c in named]).orderBy("model")


def _values(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The different values in the wanted (model, measure, cell), with their number in all batches."""
    batches = scale.stage(spark.read.schema(_CELLS).parquet(f"{path}/cells").select("batch").distinct())
    keys = [*KEYS, "cell"]
    wanted = scale.stage(wanted.select(*keys).distinct())
    values = spark.read.schema(_VALUES).parquet(f"{path}/values")
    ends = wanted.agg(F.min("cell"), F.max("cell")).first()
    if ends[0] is not None:
        values = values.where(F.col("cell").between(*ends))
    values = scale.keyed_join(values, wanted, keys, ["value", "batch"], how="left_semi")
    values = scale.keyed_join(values, batches, ["batch"], ["value"], how="left_semi")
    return values.groupBy(*keys, "value").agg(F.sum("n").alias("n"))


def _running(values: DataFrame) -> DataFrame:
    """Adds ``_upto``: how many of the cell's values are at most this one. The order is
    dealt to tasks by value, so that no cell is one task's."""
    keys = [*KEYS, "cell"]
    placed = scale.stage(values.orderBy(*keys, "value").withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy(*keys, "_part").agg(F.sum("n").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy(*keys, "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("_own", F.sum("n").over(own)).join(sums, [*keys, "_part"]).withColumn("_upto", F.col("_before") + F.col("_own"))


def box(spark: SparkSession, path: str, measure: str = "inference_time", quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``evaluation.box_data`` of all batches: quartiles at p * n - 0.5, whiskers, number of outliers."""
    keys = [*KEYS, "cell"]
    held = scale.stage(cells(spark, path).where(F.col("measure") == measure))
    before = Window.partitionBy(*KEYS).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counted = held.withColumn("_below", F.coalesce(F.sum("n").over(before), F.lit(0)))
    whole = held.groupBy(*KEYS).agg(F.sum("n").alias("_all"))
    # Each quantile lies between two neighbours of the order, at these 0-based places.
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(quantiles)]))
    place = F.least(F.greatest(F.col("p") * F.col("_all") - 0.5, F.lit(0.0)), (F.col("_all") - 1).cast("double"))
    asked = whole.select(*KEYS, "_all", asked.alias("_q")).select(*KEYS, "_all", "_q.*").withColumn("_place", place)
    low, part = F.floor("_place"), F.col("_place") - F.floor("_place")
    sides = F.array(F.struct(low.alias("at"), (1 - part).alias("weight")), F.struct((low + 1).alias("at"), part.alias("weight")))
    asked = asked.select(*KEYS, "_all", "i", F.explode(sides).alias("_s")).select(*KEYS, "_all", "i", "_s.*").where("weight > 0")
    in_cell = (F.col("at") >= F.col("_below")) & (F.col("at") < F.col("_below") + F.col("n"))
    found = scale.stage(counted.join(asked, KEYS).where(in_cell).select(*keys, "_all", "i", "weight", (F.col("at") - F.col("_below")).alias("_at")))
    running = _running(_values(spark, path, found))
    here = (F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("n"))
    names = ["q1", "median", "q3"]
    quartiles = scale.stage(
        running.join(found, keys).where(here).groupBy(*KEYS, "_all").agg(
            *[F.sum(F.when(F.col("i") == i, F.col("value") * F.col("weight"))).alias(name) for i, name in enumerate(names)]
        )
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fences = quartiles.select(*KEYS, (F.col("q1") - reach).alias("_from"), (F.col("q3") + reach).alias("_to"))
    fences = fences.withColumns({"_c0": cell_of(F.col("_from")), "_c1": cell_of(F.col("_to"))})
    fenced = held.join(fences, KEYS)
    at_fence = (F.col("cell") == F.col("_c0")) | (F.col("cell") == F.col("_c1"))
    edge = _values(spark, path, fenced.where(at_fence)).join(fences, KEYS)
    inside = F.col("value").between(F.col("_from"), F.col("_to"))
    edge = edge.select(*KEYS, F.when(inside, F.col("value")).alias("low"), F.when(inside, F.col("value")).alias("high"), F.when(~inside, F.col("n")).alias("out"))
    between = (F.col("cell") > F.col("_c0")) & (F.col("cell") < F.col("_c1"))
    whole_cells = fenced.where(~at_fence).select(
        *KEYS, F.when(between, F.col("low")).alias("low"), F.when(between, F.col("high")).alias("high"), F.when(~between, F.col("n")).alias("out")
    )
    ends = edge.union(whole_cells).groupBy(*KEYS).agg(F.min("low").alias("_low"), F.max("high").alias("_high"), F.coalesce(F.sum("out"), F.lit(0)).alias("outliers"))
    return quartiles.join(ends, KEYS).select(
        "model", F.col("_all").alias("n"), *names,
        F.least("_low", "q1").alias("lower_whisker"), F.greatest("_high", "q3").alias("upper_whisker"), "outliers",
    )
