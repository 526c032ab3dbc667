import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from feedloom.operators import evaluation, run_totals

SCHEMA = "seq LONG, model STRING, inference_time DOUBLE, loading_time DOUBLE"


def runs(n, seed=3):
    """Half of the rows of one model, a third of those of one value; zeros, negatives, NaN and nulls."""
    made = random.Random(seed)
    rows = []
    for seq in range(n):
        model = "hot" if seq % 2 else made.choice(["a", "b", None])
        value = made.choice([1.5, made.expovariate(1), made.gauss(0, 1e6), made.choice([0.0, -0.0, None, math.nan])])
        rows.append((seq, model, 1.5 if seq % 3 == 0 else value, made.choice([None, 1e3 + made.random()])))
    return [*rows, (n, "one", 7.0, None), (n + 1, "none", None, math.nan), (n + 2, "two", -1.0, 2.0), (n + 3, "two", 3.0, 2.0)]


def added(spark, path, rows, batches):
    for k in range(batches):
        run_totals.add_batch(spark.createDataFrame(rows[k::batches], SCHEMA), path, f"day-{k}")
    # Again, and in two steps: the last one of a name counts.
    run_totals.add_batch(spark.createDataFrame(rows[:9], SCHEMA), path, "day-0")
    run_totals.add_batch(spark.createDataFrame(rows[::batches], SCHEMA), path, "day-0")


def near(got, expected):
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert g.asDict().keys() == e.asDict().keys()
        for name, x in e.asDict().items():
            assert g[name] == (pytest.approx(x, rel=1e-9, abs=1e-9) if isinstance(x, float) else x), (name, g, e)


def test_stats_and_boxes_of_batches_equal_those_of_all_rows(spark, tmp_path):
    rows, path = runs(3_000), str(tmp_path)
    added(spark, path, rows, 4)
    whole = spark.createDataFrame(rows, SCHEMA)
    # A model without any value has no cells, and so no row.
    expected = [r for r in evaluation.model_stats(whole).collect() if r.model != "none"]
    near(run_totals.stats(spark, path).collect(), expected)
    for measure in evaluation.MEASURES:
        expected = evaluation.box_data(whole, measure, row_id=("seq",)).orderBy("model").collect()
        near(run_totals.box(spark, path, measure).orderBy("model").collect(), expected)


def test_small_deviations_keep_their_digits(spark, tmp_path):
    values = [1e9 + k / 1024 for k in range(500)]
    for k in range(5):
        part = spark.createDataFrame([(0, "m", x, None) for x in values[k::5]], SCHEMA)
        run_totals.add_batch(part, str(tmp_path), str(k))
    got = run_totals.stats(spark, str(tmp_path)).first()
    assert got.inference_time_std == pytest.approx(statistics.stdev(values), rel=1e-12)
    assert got.loading_time_mean is None


def test_statistics_read_the_cells_only(spark, tmp_path):
    added(spark, str(tmp_path), runs(60), 4)
    read = run_totals.stats(spark, str(tmp_path)).inputFiles()
    assert read and all("/cells/" in x for x in read)
    # A hot value is one row, however often it comes.
    values = spark.read.parquet(f"{tmp_path}/values").where("model = 'hot' AND value = 1.5 AND measure = 'inference_time'")
    assert values.count() == 2 and values.agg({"n": "sum"}).first()[0] >= 10


def test_a_batch_without_its_cells_is_not_seen(spark, tmp_path):
    path = str(tmp_path)
    run_totals.add_batch(spark.createDataFrame([(k, "m", float(k), 1.0) for k in range(9)], SCHEMA), path, "whole")
    before = run_totals.box(spark, path).collect()
    # The job ended between the two writes.
    spark.read.parquet(f"{path}/values/batch=whole").write.parquet(f"{path}/values/batch=half")
    assert run_totals.box(spark, path).collect() == before


def test_cells_keep_the_order(spark):
    values = [-math.inf, -1e300, -2.0, -1.9999, -1e-300, -5e-324, 0.0, 5e-324, 1e-300, 1.0, 1.0001, 2.0, 1e300, math.inf]
    told = spark.createDataFrame([(v,) for v in values], "v DOUBLE").select("v", run_totals.cell_of(F.col("v")).alias("c"))
    cells = [r.c for r in sorted(told.collect())]
    assert cells == sorted(cells) and cells[6] == 0 and cells[5] < 0 < cells[7]


def test_odd_batch_names_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        run_totals.add_batch(spark.createDataFrame([], SCHEMA), str(tmp_path), "../a")
