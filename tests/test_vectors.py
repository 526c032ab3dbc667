import hashlib
import math
import re
from collections import Counter

from feedloom.functions import vectors as vx
from feedloom.operators.embedding import ModelEmbedder, embed


def python_counts(text, dim=vx.DIM):
    words = re.findall(r"[^\W_]+", text.lower())
    return dict(Counter(int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % dim for w in words))


TEXTS = ["The cat and the hat", "", "  ?! ", "a a a a b", "éa ÉA Straße 42", None]


def test_token_counts(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i INT, text STRING")
    for row in embed(rows).collect():
        if row.text is None:
            assert row.vec is None
            continue
        assert {e.bucket: e.weight for e in row.vec} == python_counts(row.text)
        assert [e.bucket for e in row.vec] == sorted(e.bucket for e in row.vec)


def test_dense_counts(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "text STRING")
    for row in rows.select("text", vx.token_counts("text", 7).alias("v")).withColumn("d", vx.dense_counts("v", 7)).collect():
        counts = python_counts(row.text, 7)
        assert row.d == [counts.get(b, 0) for b in range(7)]


def cosine(a, b):
    na, nb = (math.sqrt(sum(x * x for x in v)) for v in (a, b))
    return sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 0.0


def test_dense_cosine(spark):
    pairs = [([1.0, 2.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [0.0, 5.0]), ([3.0, 4.0], [-3.0, -4.0])]
    rows = spark.createDataFrame(pairs, "a ARRAY<FLOAT>, b ARRAY<FLOAT>")
    for row in rows.select("a", "b", vx.cosine("a", "b").alias("c")).collect():
        assert math.isclose(row.c, cosine(row.a, row.b), abs_tol=1e-12)


def test_sparse_cosine(spark):
    rows = spark.createDataFrame([("x y y", "y z"), ("", "x"), ("q", "r"), ("a b", "a b")], "a STRING, b STRING")
    scored = rows.select("a", "b", vx.token_counts("a").alias("va"), vx.token_counts("b").alias("vb"))
    scored = scored.select("a", "b", vx.sparse_cosine("va", "vb").alias("c"))
    for row in scored.collect():
        a, b = python_counts(row.a), python_counts(row.b)
        dense = [[v.get(i, 0) for i in range(vx.DIM)] for v in (a, b)]
        assert math.isclose(row.c, cosine(*dense), abs_tol=1e-12)


def test_model_embedder_loads_once_per_task_and_keeps_nulls(spark):
    def load():
        calls = {"loads": 0}
        calls["loads"] += 1
        return lambda texts: [[calls["loads"], len(t)] for t in texts]

    rows = spark.createDataFrame([(i, None if i % 5 == 0 else "x" * i) for i in range(100)], "i INT, text STRING")
    for row in embed(rows.coalesce(1), embedder=ModelEmbedder(load)).collect():
        assert row.vec == (None if row.i % 5 == 0 else [1.0, float(row.i)])
