"""Requests to a text generator, its prompts, and its run."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom import schemas
from feedloom.fixed_values import ITERATIONS, PROMPT_TEMPLATE
from feedloom.functions import responses as rx
from feedloom.functions.text import strip
from feedloom.operators import scale


def _numbered(n: int) -> Column:
    """1..n as an array of LONG."""
    return F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint"))


def _literal_models(models: list[dict[str, str]]) -> Column:
    return F.array(*[F.struct(*[F.lit(value).cast("string").alias(name) for name, value in m.items()]) for m in models])


def request_grid(
    questions: DataFrame,
    models: list[dict[str, str]],
    iterations: int = ITERATIONS,
    variants: int | None = None,
) -> DataFrame:
    """Every question for every model and iteration (and sampled variant).

    The models are a short list in the plan, so each question row expands in
    place: no join and no shuffle, however many questions there are. Further
    attributes of a model become columns named ``model_`` and the attribute.
    """
    extra = list(dict.fromkeys(k for m in models for k in m if k not in ("name", "id")))
    named = [{"model": m["name"], "model_id": m["id"], **{f"model_{k}": m.get(k) for k in extra}} for m in models]
    grid = (
        questions.withColumn("_model", F.explode(_literal_models(named)))
        .select("_model.model", "_model.model_id", *[f"_model.model_{k}" for k in extra], *questions.columns)
        .withColumn("iteration", F.explode(_numbered(iterations)))
    )
    if variants is not None:
        grid = grid.withColumn("variant", F.explode(_numbered(variants)))
    return grid


def variant_grid(questions: DataFrame, variants: int) -> DataFrame:
    """Every question ``variants`` times, numbered from 1."""
    return questions.withColumn("variant", F.explode(_numbered(variants)))


def build_prompts(
    df: DataFrame, template: str = PROMPT_TEMPLATE, question: str = "question", out: str = "prompt"
) -> DataFrame:
    """Put the stripped question in the place of ``{query}``."""
    return df.withColumn(out, F.replace(F.lit(template), F.lit("{query}"), strip(F.col(question))))


def strip_echo(
    df: DataFrame, output: str = "response", prompt: str = "prompt", applies: Column | None = None
) -> DataFrame:
    """Cut a repeated prompt off the output; ``applies`` limits it to the rows
    whose kind of model repeats its input."""
    cut = rx.without_echo(F.col(output), F.col(prompt))
    return df.withColumn(output, cut if applies is None else F.when(applies, cut).otherwise(F.col(output)))


def _answers(call: Callable[[list[str]], list[str]], prompts: list[str]) -> list[tuple]:
    """(output, seconds, error) of each prompt. If a call of several fails, each is
    asked by itself, so that one bad prompt does not cost the others their answer."""
    began = time.perf_counter()
    try:
        outputs = list(call(prompts))
        if len(outputs) != len(prompts):
            raise ValueError(f"{len(outputs)} outputs of {len(prompts)} prompts")
    except Exception as error:
        if len(prompts) > 1:
            return [answer for prompt in prompts for answer in _answers(call, [prompt])]
        return [(None, None, f"{type(error).__name__}: {error}")]
    seconds = (time.perf_counter() - began) / len(prompts)
    return [(output, seconds, None) for output in outputs]


def generate(
    requests: DataFrame,
    load: Callable[[str], Callable],
    model: str = "model",
    prompt: str = "prompt",
    spread_by: tuple[str, ...] = ("iteration", "question_idx"),
    batch_size: int | None = None,
) -> DataFrame:
    """Run a generator over the requests.

    ``load`` takes a model name and returns a function from prompt to output, or,
    with a ``batch_size``, from a list of at most so many prompts to their outputs.
    Requests are range-partitioned by model and ``spread_by``: every core gets
    its share of this slow step, a model with many requests is split over
    tasks, and a task sees few models, holds one at a time and loads each once.
    Adds ``response``, the seconds of that call (of a batch, an equal share)
    as ``inference_time``, those of the load as ``loading_time``, and ``error``:
    a model that fails does not fail the job, nor a prompt its batch.
    """
    schema = T.StructType(requests.schema.fields + schemas.ANSWERS.fields)
    added = schemas.ANSWERS.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, call, load_seconds, failure = None, None, None, None
        for batch in batches:
            results = []
            for name, rows in itertools.groupby(zip(batch[model], batch[prompt]), key=lambda row: row[0]):
                prompts = [text for _, text in rows]
                if name != current:
                    current, call, load_seconds, failure = name, None, None, None
                    began = time.perf_counter()
                    try:
                        call = load(name)
                        load_seconds = time.perf_counter() - began
                    except Exception as error:
                        failure = f"{type(error).__name__}: {error}"
                if call is None:
                    results += [(None, None, None, failure)] * len(prompts)
                    continue
                many = call if batch_size else lambda one, call=call: [call(one[0])]
                for part in itertools.batched(prompts, batch_size or 1):
                    told = _answers(many, list(part))
                    results += [(output, seconds, load_seconds, error) for output, seconds, error in told]
            answers = pd.DataFrame(results, columns=added, index=batch.index)
            yield pd.concat([batch, answers], axis=1)

    parts = scale.shuffle_partitions(requests.sparkSession)
    order = [model, *[c for c in spread_by if c in requests.columns]]
    return requests.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(run, schema)


def replay(requests: DataFrame, recorded: DataFrame, keys: tuple[str, ...] = ("model", "iteration", "question_idx")) -> DataFrame:
    """The offline generator: outputs recorded earlier, by request key.

    Requests without a recording keep a null response. Of several recordings of
    one request one is taken, the least by its columns, so no request is doubled.
    """
    rest = [c for c in recorded.columns if c not in keys]
    once = recorded.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_first")).select(*keys, "_first.*")
    return requests.join(once, list(keys), "left")
