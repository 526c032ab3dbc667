"""From generator responses to the report tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators import evaluation, generation, parsing, scale


def run_models(
    requests: DataFrame, load: Callable[[str], Callable[[str], str]]
) -> tuple[DataFrame, DataFrame]:
    """Run a generator over the requests: its answers, and its (model, error) table.

    The answers are staged: generation is neither cheap nor repeatable, and
    both results read it.
    """
    answers = scale.stage(generation.generate(requests, load))
    errors = answers.where(F.col("error").isNotNull()).select("model", "error")
    return answers.drop("error"), errors


def evaluate(requests: DataFrame, recorded: DataFrame, errors: DataFrame) -> DataFrame:
    """Benchmark records: recorded outputs of the requests, parsed, without
    models that failed. ``requests`` has prompts; ``recorded`` adds response,
    inference_time and loading_time."""
    return records_of(generation.replay(requests, recorded), errors)


def records_of(answers: DataFrame, errors: DataFrame) -> DataFrame:
    """Benchmark records from answers to prompts, without models that failed."""
    # Kinds of model that do not repeat their input say so in ``model_type``.
    repeats = F.coalesce(F.col("model_type") != "chat", F.lit(True)) if "model_type" in answers.columns else None
    answered = answers.transform(generation.strip_echo, applies=repeats)
    parsed = answered.transform(parsing.slice_json, "first").transform(parsing.parse_queries, "marker")
    return evaluation.drop_failed_models(parsed, errors).transform(evaluation.load_once)


def report_tables(records: DataFrame, seq: str) -> dict[str, DataFrame]:
    """The tables behind the report, by name; records and stats are staged once."""
    records = scale.stage(records)
    stats = scale.stage(evaluation.model_stats(records))
    return {
        "records": records,
        "stats": stats,
        "inference_bars": evaluation.bar_data(stats, "inference_time"),
        "loading_bars": evaluation.bar_data(stats, "loading_time"),
        "inference_boxes": evaluation.box_data(records, "inference_time", row_id=(seq,)),
        "loading_boxes": evaluation.box_data(records, "loading_time", row_id=(seq,)),
        "samples": evaluation.sample_outputs(records, seq),
    }
