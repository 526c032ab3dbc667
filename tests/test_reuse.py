import hashlib

import pytest
from pyspark.sql import functions as F

from feedloom.operators import reuse
from feedloom.operators.embedding import embed


def test_keys_are_md5_of_utf8(spark):
    rows = spark.createDataFrame([("é",), ("",), (None,)], "v STRING")
    got = [r.k for r in reuse.with_key(rows, "v", "k").collect()]
    assert got == [hashlib.md5("é".encode()).hexdigest(), hashlib.md5(b"").hexdigest(), None]


def test_first_seen_wins_and_null_keys_are_apart(spark):
    data = [("a", 3, "late"), ("a", 1, "first"), ("b", None, "unplaced"), ("b", 9, "placed"), ("c", None, "only"), (None, 1, "x"), (None, 2, "y")]
    rows = spark.createDataFrame(data, "k STRING, seq INT, v STRING")
    got = {(r.k, r.v) for r in reuse.dedupe_by_key(rows, "k", ["seq"]).collect()}
    assert got == {("a", "first"), ("b", "placed"), ("c", "only")}
    assert {r.v for r in reuse.keyless(rows, "k").collect()} == {"x", "y"}


def test_hot_key_is_combined_before_the_shuffle(spark):
    rows = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    deduped = reuse.dedupe_by_key(rows, "k", ["id"])
    plan = deduped._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan
    assert deduped.where("k = 'hot'").first().id == 0


@pytest.mark.parametrize("broadcast_rows", [100, 2, 0])
def test_negative_entries_count_as_known(spark, broadcast_rows):
    rows = spark.createDataFrame([("b", 2), ("c", 4), (None, 5)], "k STRING, i INT")
    cache = spark.createDataFrame([("a", "text"), ("b", ""), ("x", "y")], "k STRING, text STRING")
    assert {r.i for r in reuse.new_only(rows, cache, "k", ["i"], broadcast_rows).collect()} == {4}


def test_extend_cache_adds_each_new_key_once(spark):
    cache = spark.createDataFrame([("a", "old")], "k STRING, text STRING")
    found = spark.createDataFrame([("a", "new", 1), ("b", "x", 3), ("b", "y", 2), (None, "z", 1)], "k STRING, text STRING, seq INT")
    added = [tuple(r) for r in reuse.extend_cache(cache, found, "k", ["seq"]).collect()]
    assert added == [("b", "y")]


def test_embed_distinct_equals_embed(spark):
    texts = ["same text"] * 40 + [f"text {i} of its own" for i in range(60)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")
    direct = {r.id: r.vec for r in embed(rows).collect()}
    shared = {r.id: r.vec for r in reuse.embed_distinct(rows, ["id"]).collect()}
    assert shared == direct


class Counting:
    """An embedder that counts the texts it is given."""

    def __init__(self, spark):
        self.calls = spark.sparkContext.accumulator(0)

    def embed(self, df, col, out):
        calls = self.calls

        @F.udf("array<float>")
        def run(text):
            calls.add(1)
            return [float(len(text))]

        return df.withColumn(out, run(F.col(col)))


def test_embed_distinct_runs_the_model_once_per_text(spark):
    counting = Counting(spark)
    rows = spark.createDataFrame([(i, f"text {i % 7}") for i in range(200)], "id INT, text STRING")
    vectors = reuse.embed_distinct(rows, ["id"], embedder=counting)
    assert vectors.count() == 200 and vectors.where("vec is null").count() == 0
    assert counting.calls.value == 7


def test_vector_cache_spares_known_texts(spark, tmp_path):
    counting, path = Counting(spark), str(tmp_path / "vectors")
    first = spark.createDataFrame([(i, f"text {i % 3}") for i in range(9)], "id INT, text STRING")
    second = spark.createDataFrame([(i, f"text {i % 5}") for i in range(10)] + [(99, None)], "id INT, text STRING")
    assert reuse.embed_distinct(first, ["id"], embedder=counting, cache_path=path).count() == 9
    assert counting.calls.value == 3
    got = reuse.embed_distinct(second, ["id"], embedder=counting, cache_path=path).collect()
    assert counting.calls.value == 5
    assert {r.id: r.vec for r in got} == {**{i: [6.0] for i in range(10)}, 99: None}
    assert spark.read.parquet(path).count() == 5


def test_cached_text(spark):
    rows = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "unknown"), (4, None), (5, "good")], "id INT, url STRING")
    cache = reuse.with_key(spark.createDataFrame([("good", "text"), ("bad", "")], "url STRING, text STRING"), "url", "url_key")
    got = {r.id: r.text for r in reuse.cached_text(rows, cache.select("url_key", "text"), ["id"]).collect()}
    assert got == {1: "text", 2: None, 3: None, 4: None, 5: "text"}
