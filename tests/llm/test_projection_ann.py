import math

import numpy as np

from feedloom.llm import projection_ann as pa, queries

SCHEMA = "vec_id long, embedding array<float>, slot int, kind int"


def brute(rows, wanted, k=10):
    """Exact neighbours; rows of (id, vector)."""
    good = [
        (i, np.array(v, float)) for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    out = {}
    for i, v in good:
        if wanted(i):
            near = sorted({(math.sqrt(((v - w) ** 2).sum()), j) for j, w in good if j != i and len(w) == len(v)})[:k]
            out[i] = [j for _, j in near]
    return out


def search(spark, rows, wanted, k=10):
    table = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA)
    index = pa.build_index(table, "vec_id", "embedding")
    got = pa.nearest(index, table.where(wanted), "vec_id", "embedding", k).orderBy("query_id", "rank").collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r.vec_id)
    return found


def test_chi_square_against_published_quantiles():
    assert abs(pa.quantile(0.95, 10) - 18.307) < 1e-3 and abs(pa.quantile(0.99, 8) - 20.090) < 1e-3


def test_recall_over_the_table(spark):
    from conftest import SF_DIR

    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    got = queries.QUERIES["op10_nearest"](spark, SF_DIR).collect()
    exact = brute(rows, lambda i: i % 100 == 0)
    found = {(r.query_id, r.vec_id) for r in got}
    hits = sum((q, j) in found for q, near in exact.items() for j in near)
    assert hits >= 0.9 * sum(map(len, exact.values())) and len(got) == len(found)
    vectors = {i: np.array(v, float) for i, v in rows}
    for r in got:
        assert abs(r.score - math.sqrt(((vectors[r.query_id] - vectors[r.vec_id]) ** 2).sum())) < 1e-12


def test_recall_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(pa, "BLOCK_ROWS", 300)
    points = np.random.default_rng(1).standard_normal((3000, 24)).astype("f4").tolist()
    rows = list(enumerate(points))
    got, exact = search(spark, rows, "vec_id % 100 = 0"), brute(rows, lambda i: i % 100 == 0)
    assert sum(len(set(got[q]) & set(exact[q])) for q in exact) >= 0.9 * 10 * len(exact)


def test_ties_go_to_smaller_ids(spark):
    same = [1.0, 2.0]
    rows = [(i, same) for i in range(200, -1, -1)] + [(300, [1.0, 2.5]), (300, [1.0, 2.5])]
    got = search(spark, rows, "vec_id in (0, 5, 300)")
    assert got == {0: list(range(1, 11)), 5: [0, 1, 2, 3, 4, 6, 7, 8, 9, 10], 300: list(range(10))}


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (None, [1.0, 0.1]), (7, [1.0, 1.0]), (8, [1.0, 1.0, 1.0])]
    assert search(spark, rows, "vec_id >= 0") == {0: [7], 7: [0]}


def test_no_vectors(spark):
    assert search(spark, [], "vec_id = 0") == {}


def test_different_vectors_at_one_distance_go_by_id():
    base = np.full(40, 5.0)
    around = np.concatenate([np.eye(40), -np.eye(40)]) + base
    ids = np.random.default_rng(3).permutation(80) + 1
    block = pa.Block(np.append(ids, 1000), np.vstack([around, base]), 10)
    assert [i for _, i in block.nearest(1000, base, 1e9)] == list(range(1, 11))
    assert [i for _, i in block.nearest(4, base, 1e9)] == [1000, 1, 2, 3, 5, 6, 7, 8, 9, 10]
