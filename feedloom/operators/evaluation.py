"""Aggregates and report tables over recorded generator runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.binding import bind
from feedloom.operators import scale
from feedloom.operators.quantiles import counted_quantiles

MEASURES = ("inference_time", "loading_time")


def append_runs(*runs: DataFrame) -> DataFrame:
    """All rows of all runs; fields a run lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)


def drop_failed_models(
    runs: DataFrame, errors: DataFrame, model: str = "model", spread_by: tuple[str, ...] = ("iteration", "question_idx")
) -> DataFrame:
    """Rows of models without any error; ``errors`` is an (model, error) table."""
    failed = errors.select(model).where(F.col(model).isNotNull()).distinct()
    return scale.keyed_join(runs, failed, [model], list(spread_by), how="left_anti").select(runs.columns)


def load_once(runs: DataFrame, question: str = "question_idx", loading: str = "loading_time") -> DataFrame:
    """Keep the loading time on the first question of an iteration only."""
    return runs.withColumn(loading, F.when(F.col(question) == 1, F.col(loading)))


def missing_as_null(runs: DataFrame, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """Measures that are not a number are missing, as null ones are."""
    own = [m for m in measures if m in runs.columns]
    return runs.withColumns({m: F.when(~F.isnan(F.col(m).cast("double")), F.col(m)) for m in own})


def model_stats(runs: DataFrame, model: str = "model", measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """Mean, sample standard deviation, minimum and maximum per model, sorted by
    model. Missing values are skipped and rows without a model left out."""
    runs = missing_as_null(runs, measures)
    stats = [
        stat(measure).alias(f"{measure}_{name}")
        for measure in measures
        for name, stat in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
    ]
    return runs.where(F.col(model).isNotNull()).groupBy(model).agg(*stats).orderBy(model)


def bar_data(stats: DataFrame, measure: str = "inference_time", model: str = "model") -> DataFrame:
    """Bar height with the ends of its error bar."""
    mean, std = F.col(f"{measure}_mean"), F.col(f"{measure}_std")
    return stats.select(
        model, F.lit(measure).alias("measure"), mean.alias("mean"), (mean - std).alias("low"), (mean + std).alias("high")
    )


def box_data(
    runs: DataFrame,
    measure: str = "inference_time",
    model: str = "model",
    row_id: tuple[str, ...] = ("iteration", "question_idx"),
    method: str = "plotly",
) -> DataFrame:
    """Quartiles, whiskers and the number of outliers per model.

    A whisker ends at the furthest value within 1.5 interquartile ranges of its
    quartile. ``box_outliers`` lists the values beyond.
    """
    runs = missing_as_null(runs, (measure,))
    quartiles, few = counted_quantiles(
        runs, model, measure, {"q1": 0.25, "median": 0.5, "q3": 0.75}, list(row_id), method
    )
    value, reach = F.col("_value"), 1.5 * (F.col("q3") - F.col("q1"))
    near_low, near_high = value >= F.col("q1") - reach, value <= F.col("q3") + reach
    rows = runs.where(F.col(measure).isNotNull()).select(
        model, *row_id, F.col(measure).cast("double").alias("_value")
    )
    return (
        scale.keyed_join(rows, quartiles, [model], list(row_id), small=few)
        .groupBy(model, "n", "q1", "median", "q3")
        .agg(
            F.min(F.when(near_low, value)).alias("_low"),
            F.max(F.when(near_high, value)).alias("_high"),
            F.count_if(~(near_low & near_high)).alias("outliers"),
        )
        .select(
            model,
            "n",
            "q1",
            "median",
            "q3",
            F.least("_low", "q1").alias("lower_whisker"),
            F.greatest("_high", "q3").alias("upper_whisker"),
            "outliers",
        )
    )


def box_outliers(
    runs: DataFrame,
    box: DataFrame,
    measure: str = "inference_time",
    model: str = "model",
    row_id: tuple[str, ...] = ("iteration", "question_idx"),
) -> DataFrame:
    """The rows whose measure lies beyond the whiskers of their model.

    The whiskers are staged: one row per model, not the box plot's passes again.
    """
    runs = missing_as_null(runs, (measure,))
    fences = scale.stage(box.select(model, "lower_whisker", "upper_whisker"))
    return (
        scale.keyed_join(runs.where(F.col(measure).isNotNull()), fences, [model], list(row_id))
        .where((F.col(measure) < F.col("lower_whisker")) | (F.col(measure) > F.col("upper_whisker")))
        .select(runs.columns)
    )


def sample_outputs(runs: DataFrame, seq: str, model: str = "model", output: str = "output") -> DataFrame:
    """What each model answered in its first iteration.

    Models come in the order they were first seen, ``first_seen`` being the
    lowest ``seq`` of the model; the time is written with four decimals.
    """
    first_seen = runs.where(F.col(model).isNotNull()).groupBy(model).agg(F.min(seq).alias("first_seen"))
    samples = runs.where(F.col("iteration") == 1).select(
        model,
        seq,
        "question_idx",
        "question",
        output,
        F.format_string("%.4f", "inference_time").alias("inference_time"),
    )
    return scale.keyed_join(samples, first_seen, [model], [seq]).orderBy("first_seen", seq)


def diversity(df: DataFrame, output: str = "output", out: str = "diversity") -> DataFrame:
    """How different the queries of one response are: 1 minus the mean Jaccard
    similarity of the word sets of its pairs; null with fewer than two queries.

    Pairs are formed inside the row only.
    """
    words = F.transform(output, lambda q: F.array_distinct(F.array_remove(F.split(F.lower(q), r"\s+"), "")))

    def similarities(sets: Column) -> Column:
        n = F.size(sets)
        return F.flatten(
            F.transform(
                F.sequence(F.lit(1), n - 1),
                lambda i: F.transform(F.slice(sets, i + 1, n), lambda other: _jaccard(F.element_at(sets, i), other)),
            )
        )

    def spread(sets: Column) -> Column:
        found = similarities(sets)
        mean = F.aggregate(found, F.lit(0.0), lambda total, x: total + x) / F.size(found)
        return F.when(F.size(sets) >= 2, 1 - mean)

    return df.withColumn(out, bind(words, spread))


def _jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; 1 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(1.0))
