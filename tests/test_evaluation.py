import math
import statistics

import pytest
from pyspark.sql import functions as F

from feedloom.operators import evaluation, generation
from feedloom.operators.quantiles import exact_quantiles
from feedloom.plans.evaluation import evaluate, records_of, report_tables, run_models

RECORDS = "model STRING, iteration LONG, question_idx LONG, inference_time DOUBLE, loading_time DOUBLE"


def test_stats(spark):
    data = [("b", 1, 1, 1.0, 5.0), ("b", 1, 2, 2.0, None), ("b", 2, 1, 4.0, 7.0), ("a", 1, 1, 3.0, None), (None, 1, 1, 9.0, 9.0)]
    got = evaluation.model_stats(spark.createDataFrame(data, RECORDS)).collect()
    assert [r.model for r in got] == ["a", "b"]
    a, b = got
    assert (a.inference_time_mean, a.inference_time_std, a.loading_time_mean, a.loading_time_min) == (3.0, None, None, None)
    assert math.isclose(b.inference_time_std, statistics.stdev([1.0, 2.0, 4.0]))
    assert (b.loading_time_mean, b.loading_time_min, b.loading_time_max) == (6.0, 5.0, 7.0)


def test_load_once(spark):
    data = [("a", 1, q, 1.0, 2.0) for q in (1, 2, 3)]
    got = evaluation.load_once(spark.createDataFrame(data, RECORDS)).orderBy("question_idx").collect()
    assert [r.loading_time for r in got] == [2.0, None, None]


def test_failed_models_are_dropped_whole(spark):
    runs = spark.createDataFrame([("a", 1, 1, 1.0, 1.0), ("b", 1, 1, 1.0, 1.0), ("b", 2, 1, 1.0, 1.0)], RECORDS)
    errors = spark.createDataFrame([("b", "x"), ("b", "y"), (None, "z")], "model STRING, error STRING")
    kept = evaluation.drop_failed_models(runs, errors)
    assert [r.model for r in kept.collect()] == ["a"] and kept.columns == runs.columns


def test_append_keeps_duplicates_and_fills_missing(spark):
    a = spark.createDataFrame([(1, "x")], "i INT, v STRING")
    b = spark.createDataFrame([(1,), (1,)], "i INT")
    assert sorted((r.i, r.v or "") for r in evaluation.append_runs(a, b, a).collect()) == [(1, ""), (1, ""), (1, "x"), (1, "x")]


def python_quantile(values, p, method):
    values, n = sorted(values), len(values)
    place = p * n - 0.5 if method == "plotly" else p * (n - 1)
    place = min(max(place, 0), n - 1)
    low = math.floor(place)
    return values[low] * (1 - (place - low)) + values[min(low + 1, n - 1)] * (place - low)


GROUPS = {
    "one": [4.0],
    "two": [1.0, 3.0],
    "four": [1.0, 2.0, 3.0, 4.0],
    "ties": [5.0] * 700 + [float(i) for i in range(300)],
    "spread": [float(i * 7919 % 1_009) for i in range(999)],
}


@pytest.mark.parametrize("method", ["plotly", "linear"])
@pytest.mark.parametrize("accuracy", [10_000, 1])
def test_quantiles_are_exact_whatever_the_sketch(spark, method, accuracy):
    data = [(g, i, v) for g, values in GROUPS.items() for i, v in enumerate(values)] + [("four", 99, None), (None, 1, 1.0)]
    rows = spark.createDataFrame(data, "g STRING, i INT, v DOUBLE").repartition(4)
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75, "low": 0.0, "high": 1.0}
    got = exact_quantiles(rows, "g", "v", probs, ["i"], method, accuracy).collect()
    assert {r.g for r in got} == set(GROUPS)
    for row in got:
        assert row.n == len(GROUPS[row.g])
        for name, p in probs.items():
            assert math.isclose(row[name], python_quantile(GROUPS[row.g], p, method)), (row.g, name)


def test_box(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 100.0, -50.0]
    runs = spark.createDataFrame([("m", 1, i, v, None) for i, v in enumerate(values)], RECORDS)
    box = evaluation.box_data(runs).first()
    assert (box.median, box.lower_whisker, box.upper_whisker, box.outliers) == (4.0, 1.0, 7.0, 2)
    beyond = evaluation.box_outliers(runs, evaluation.box_data(runs))
    assert sorted(r.inference_time for r in beyond.collect()) == [-50.0, 100.0]


def test_samples_come_in_first_seen_order(spark):
    rows = [("z", 0, 1, 1, 0.12345), ("a", 1, 1, 1, 1234.5), ("z", 2, 1, 2, 2.0), ("a", 3, 2, 1, 3.0)]
    runs = spark.createDataFrame(rows, "model STRING, seq LONG, iteration LONG, question_idx LONG, inference_time DOUBLE")
    runs = runs.withColumn("question", F.lit("q")).withColumn("output", F.lit("o"))
    got = evaluation.sample_outputs(runs, "seq").collect()
    assert [(r.model, r.inference_time) for r in got] == [("z", "0.1235"), ("z", "2.0000"), ("a", "1234.5000")]


def test_grid(spark):
    questions = spark.createDataFrame([(1, "q1"), (2, "q2")], "question_idx LONG, question STRING")
    models = [{"name": "a", "id": "x/a"}, {"name": "b", "id": "x/b"}]
    grid = generation.request_grid(questions, models, iterations=3, variants=2).collect()
    assert len({(r.model, r.iteration, r.question_idx, r.variant) for r in grid}) == len(grid) == 24
    assert {r.iteration for r in grid} == {1, 2, 3} and {(r.model, r.model_id) for r in grid} == {("a", "x/a"), ("b", "x/b")}


def test_prompts(spark):
    rows = spark.createDataFrame([("  what {query} $1 \\1 is\n",)], "question STRING")
    prompt = generation.build_prompts(rows, "Q: {query}\nA:").first().prompt
    assert prompt == "Q: what {query} $1 \\1 is\nA:"


def test_generate_loads_each_model_once_per_task(spark):
    loads = spark.sparkContext.accumulator(0)

    def load(model):
        loads.add(1)
        return lambda prompt: f"{model}:{prompt}"

    data = [("a" if i % 3 else "b", i, f"p{i}") for i in range(300)]
    rows = spark.createDataFrame(data, "model STRING, question_idx INT, prompt STRING")
    got = generation.generate(rows, load).collect()
    assert {r.response for r in got} == {f"{m}:p{i}" for m, i, _ in data}
    assert all(r.inference_time >= 0 and r.loading_time >= 0 and r.error is None for r in got)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Contiguous ranges: each task starts with one load, and one model boundary adds another.
    assert 2 <= loads.value <= parts + 1


def test_generate_in_batches_keeps_every_answer(spark):
    sizes = spark.sparkContext.accumulator(0)

    def load(model):
        if model == "gone":
            raise OSError("no weights")

        def call(prompts):
            assert isinstance(prompts, list) and 1 <= len(prompts) <= 16
            sizes.add(len(prompts) > 1)
            if "p7" in prompts:
                raise ValueError("too long")
            return [f"{model}:{p}" for p in prompts][: 1 if "p50" in prompts else None]

        return call

    data = [("a" if i % 3 else "gone", i, f"p{i}") for i in range(300)]
    rows = spark.createDataFrame(data, "model STRING, question_idx INT, prompt STRING")
    got = {r.question_idx: r for r in generation.generate(rows, load, batch_size=16).collect()}
    assert len(got) == 300 and sizes.value > 0
    for model, i, prompt in data:
        if model == "gone":
            assert got[i].response is None and got[i].error == "OSError: no weights"
        elif i == 7:
            assert got[i].response is None and got[i].error == "ValueError: too long" and got[i].loading_time >= 0
        else:
            assert got[i].response == f"a:{prompt}" and got[i].error is None and got[i].inference_time >= 0


def test_evaluate_and_report(spark):
    questions = spark.createDataFrame([(1, "q1"), (2, "q2")], "question_idx LONG, question STRING")
    models = [{"name": n, "id": n} for n in ("good", "broken")]
    requests = generation.build_prompts(generation.request_grid(questions, models, 2))
    recorded = requests.select(
        "model", "iteration", "question_idx",
        F.concat("prompt", F.lit('\n{"queries": ["B", "a", "b"]}')).alias("response"),
        F.col("question_idx").cast("double").alias("inference_time"),
        F.lit(1.5).alias("loading_time"),
    )
    errors = spark.createDataFrame([("broken", "out of memory")], "model STRING, error STRING")
    records = evaluate(requests, recorded, errors).withColumn("seq", F.col("iteration") * 10 + F.col("question_idx"))
    tables = report_tables(records, "seq")
    assert {tuple(r.output) for r in tables["records"].collect()} == {("a", "b")}
    stats = tables["stats"].collect()
    assert [(r.model, r.inference_time_mean, r.loading_time_mean) for r in stats] == [("good", 1.5, 1.5)]
    assert [(r["mean"], r.low is None) for r in tables["inference_bars"].collect()] == [(1.5, False)]
    assert tables["inference_boxes"].first().n == 4
    assert tables["samples"].count() == 2


def test_a_failing_model_is_reported_and_dropped(spark):
    def load(model):
        if model == "unloadable":
            raise MemoryError("too large")

        def call(prompt):
            if model == "flaky" and "q2" in prompt:
                raise ValueError("bad token")
            return prompt + '{"queries": ["A"]}'

        return call

    questions = spark.createDataFrame([(1, "q1"), (2, "q2")], "question_idx LONG, question STRING")
    models = [{"name": n, "id": n} for n in ("good", "unloadable", "flaky")]
    requests = generation.build_prompts(generation.request_grid(questions, models, 2))
    answers, errors = run_models(requests, load)
    assert {tuple(r) for r in errors.collect()} == {("unloadable", "MemoryError: too large"), ("flaky", "ValueError: bad token")}
    records = records_of(answers, errors).collect()
    assert {(r.model, r.iteration, r.question_idx, tuple(r.output)) for r in records} == {
        ("good", i, q, ("a",)) for i in (1, 2) for q in (1, 2)
    }
    assert all((r.loading_time is not None) == (r.question_idx == 1) for r in records)


def test_versions_of_nested_outputs(spark):
    from feedloom.operators.parsing import explode_outputs

    rows = spark.createDataFrame([(1, [["a", "b"], ["c"]])], "i INT, output ARRAY<ARRAY<STRING>>")
    assert [(r.version, r["query"]) for r in explode_outputs(rows).collect()] == [(1, ["a", "b"]), (2, ["c"])]


def test_not_a_number_is_missing(spark):
    nan = float("nan")
    rows = [("m", i, float(v), nan) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 100])] + [("m", 8, nan, None)]
    runs = spark.createDataFrame(rows, "model STRING, seq LONG, inference_time DOUBLE, loading_time DOUBLE")
    stats = evaluation.model_stats(runs).first()
    assert stats.inference_time_max == 100 and stats.inference_time_mean == 16 and stats.loading_time_mean is None
    box = evaluation.box_data(runs, row_id=("seq",))
    assert box.first().n == 8 and box.first().q1 == 2.5
    assert [r.seq for r in evaluation.box_outliers(runs, box, row_id=("seq",)).collect()] == [7]


def test_replay_takes_one_recording_per_request(spark):
    asked = spark.createDataFrame([("m", 1, 1)], "model STRING, iteration INT, question_idx INT")
    told = spark.createDataFrame([("m", 1, 1, "b"), ("m", 1, 1, "a")], "model STRING, iteration INT, question_idx INT, response STRING")
    assert [r.response for r in generation.replay(asked, told).collect()] == ["a"]


def test_grid_carries_all_attributes_of_models(spark):
    models = [{"name": "a", "id": "x/a", "type": "chat"}, {"name": "b", "id": "x/b"}]
    grid = generation.request_grid(spark.createDataFrame([(1,)], "q INT"), models, iterations=1)
    assert sorted((r.model, r.model_type) for r in grid.collect()) == [("a", "chat"), ("b", None)]
