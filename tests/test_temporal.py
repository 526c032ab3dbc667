import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedloom.operators import temporal

START = datetime(2024, 3, 1)
LEFT = "id LONG, k STRING, t TIMESTAMP_NTZ, _range STRING"
RIGHT = "k STRING, t TIMESTAMP_NTZ, nth LONG, v STRING"


def times(seed, n, keys, spread):
    own = random.Random(seed)
    return [(own.choice(keys), START + timedelta(seconds=own.randint(0, spread)) if own.random() < 0.95 else None) for _ in range(n)]


@pytest.mark.parametrize("range_rows", [500_000, 7])
def test_asof_like_a_search(spark, range_rows):
    keys = ["a", "a", "a", "a", "b", "c", None]  # one key has most of the rows
    left = [(n, k, t, "own") for n, (k, t) in enumerate(times(1, 150, keys, 60))]
    right = [(k, t, n, f"v{n}" if n % 5 else None) for n, (k, t) in enumerate(times(2, 150, keys, 60))]
    got = temporal.asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), "k", "t", "nth", range_rows=range_rows)
    assert got.columns == ["id", "k", "t", "_range", "last_t", "last_nth", "last_v"]
    found = {r.id: (r.last_t, r.last_nth, r.last_v) for r in got.collect()}
    assert len(found) == len(left)
    for n, k, t, _ in left:
        before = [(x, nth, v) for key, x, nth, v in right if k is not None and t is not None and key == k and x is not None and x < t]
        assert found[n] == max(before, key=lambda b: b[:2], default=(None, None, None))


def test_asof_of_empty_sides(spark):
    left, right = spark.createDataFrame([(1, "a", START, "")], LEFT), spark.createDataFrame([], RIGHT)
    assert temporal.asof_join(left, right, "k", "t", "nth").collect()[0].last_nth is None
    assert temporal.asof_join(left.limit(0), spark.createDataFrame([("a", START, 1, "v")], RIGHT), "k", "t", "nth").count() == 0


def test_asof_has_no_cross_join(spark):
    left, right = spark.createDataFrame([(1, "a", START, "")], LEFT), spark.createDataFrame([("a", START, 1, "v")], RIGHT)
    plan = temporal.asof_join(left, right, "k", "t", "nth")._jdf.queryExecution().toString()
    assert "Join" not in plan and "hashpartitioning(_k" in plan  # one exchange, no join


@pytest.mark.parametrize("key", ["k", None])
def test_intervals_like_a_search(spark, key):
    own = random.Random(3)
    spans = [(n, own.choice("ab"), own.randint(0, 5000), own.choice([0, 1, 59, 60, 61, 240, 241, 3600, 100_000])) for n in range(80)]
    spans += [(80, "a", 0, -5), (81, None, 0, 9000)]
    points = [(n, own.choice(["a", "b", None]), own.randint(-100, 9000)) for n in range(200)]
    at = lambda s: START + timedelta(seconds=s)
    left = spark.createDataFrame([(n, k, at(s)) for n, k, s in points] + [(999, "a", None)], "point LONG, k STRING, at TIMESTAMP_NTZ")
    right = spark.createDataFrame([(n, k, at(s), at(s + x)) for n, k, s, x in spans], "span LONG, k STRING, since TIMESTAMP_NTZ, until TIMESTAMP_NTZ")
    if key is None:
        right = right.withColumnRenamed("k", "other")
    got = temporal.interval_join(left, right, key, "at", "since", "until", base=60_000_000)
    wanted = sorted((p, s) for p, k, t in points for s, other, begin, x in spans if begin <= t < begin + x and (key is None or (k is not None and k == other)))
    assert sorted((r.point, r.span) for r in got.collect()) == wanted


def test_long_intervals_lie_in_few_bins(spark):
    spans = spark.createDataFrame([(1, "a", START, START + timedelta(days=d)) for d in (1, 40, 4000)], "span LONG, k STRING, since TIMESTAMP_NTZ, until TIMESTAMP_NTZ")
    points = spark.createDataFrame([(1, "a", START + timedelta(hours=5))], "point LONG, k STRING, at TIMESTAMP_NTZ")
    found = temporal.interval_join(points, spans, "k", "at", "since", "until", base=60_000_000)
    assert found.count() == 3
    assert "Cartesian" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
    assert found.select(F.count("*")).first()[0] == 3
