import math
import random

import pytest
from conftest import SF_DIR

from feedloom.operators import pruned

SCHEMA = "id LONG, vec ARRAY<FLOAT>, item LONG"


def plainly(rows, asked, k):
    unit = {}
    for n, v in rows:
        norm = math.sqrt(sum(x * x for x in v or []))
        if norm:
            unit[n] = [x / norm for x in v]
    out = {}
    for q in asked:
        if q in unit:
            scored = sorted((-round(sum(a * b for a, b in zip(unit[q], v)), 9), n) for n, v in unit.items() if n != q)
            out[q] = [-s for s, _ in scored[:k]]
    return out


@pytest.mark.parametrize("pivots,first", [(16, 2), (3, 1), (1, 1), (200, 200)])
def test_best_of_clustered_vectors(spark, pivots, first):
    own = random.Random(pivots)
    centres = [[own.gauss(0, 1) for _ in range(8)] for _ in range(10)]
    rows = [(n, [float(x + own.gauss(0, 0.1)) for x in centres[n % 10]]) for n in range(300)]
    rows += [(300, [0.0] * 8), (301, None), (302, rows[0][1]), (303, rows[0][1])]
    rows = [(n, None if v is None else [float(f) for f in map(float, v)]) for n, v in rows]
    table = spark.createDataFrame([(n, v, 7) for n, v in rows], SCHEMA)
    stored = [(r.id, r.vec) for r in table.collect()]
    best, counts = pruned.top_candidates(table, table.where("id % 25 = 0"), "id", "vec", 5, pivots, first)
    got = {}
    for r in best.orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(round(r.score, 9))
    wanted = plainly(stored, range(0, 304, 25), 5)
    assert got.keys() == wanted.keys()
    assert all(got[q] == pytest.approx(wanted[q], abs=1e-8) for q in wanted)
    if pivots == 16:
        assert all(r.scored < r.items / 2 for r in counts.collect())  # most cells were skipped


def test_few_rows_and_empty_tables(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0)], SCHEMA)
    best, _ = pruned.top_candidates(table, table, "id", "vec", 5)
    assert sorted((r.query, r.item, r.rank, r.score) for r in best.collect()) == [(1, 2, 1, 0.0), (2, 1, 1, 0.0)]
    best, _ = pruned.top_candidates(table.limit(0), table, "id", "vec", 5)
    assert best.count() == 0


def test_share_of_the_table_that_is_scored(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    _, counts = pruned.top_candidates(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 10)
    assert all(r.scored <= r.items for r in counts.collect())


def test_best_of_a_cell_are_cut_in_the_task():
    import numpy as np

    made = np.random.default_rng(3).normal(size=(400, 16))
    made /= np.linalg.norm(made, axis=1)[:, None]
    vectors = np.concatenate([made[:300], made[:300]])  # every score is there twice
    ids = np.random.default_rng(4).permutation(600)
    queries, own = made[250:], np.concatenate([ids[250:300], np.full(100, -1)])
    bounds = np.where(np.arange(150) % 3 == 0, 0.5, -np.inf)
    got = {}
    for q, v, score in zip(*pruned.best_of_cell(queries, own, bounds, vectors, ids, 7)):
        got.setdefault(int(q), []).append((-float(score), int(ids[v])))
    for q in range(150):
        # Not ``sum``, which rounds otherwise.
        products = np.cumsum(queries[q] * vectors, axis=1)[:, -1]
        scores = [(-float(x), int(n)) for x, n in zip(products, ids) if n != own[q]]
        assert got.get(q, []) == [(s, n) for s, n in sorted(scores)[:7] if -s >= bounds[q]]


def test_text_ids_other_lengths_and_vectors_that_are_not_finite(spark):
    rows = [("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("é", [0.0, 2.0]), ("z", [3.0, 3.0]), ("n", [float("nan"), 1.0])]
    rows += [("x", [1.0, 1.0, 1.0]), ("y", [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), ("o", [0.0, 0.0]), ("p", None)]
    table = spark.createDataFrame(rows, "id STRING, vec ARRAY<DOUBLE>")
    best, counts = pruned.top_candidates(table, table.where("id IN ('z', 'x')"), "id", "vec", 3, 2, 1)
    got = [(r.query, r.item, r["rank"], round(r.score, 6)) for r in best.orderBy("query", "rank").collect()]
    half = round(0.5**0.5, 6)
    assert got[0][:3] == ("x", "y", 1) and math.isnan(got[1][3])
    assert [g[1] for g in got[1:]] == ["n", "a", "b"] and got[2:] == [("z", "a", 2, half), ("z", "b", 3, half)]
    assert {r.query: r.scored for r in counts.collect()} == {"x": 1, "z": 4}


def test_repeated_rows_among_the_pivots_are_met_once_each(spark):
    own = random.Random(5)
    rows = [(n, [own.gauss(0, 1) for _ in range(4)]) for n in range(30)]
    rows += rows[10:20]
    table = spark.createDataFrame(rows, "id LONG, vec ARRAY<DOUBLE>")
    best, _ = pruned.top_candidates(table, table.where("id = 0"), "id", "vec", 20, 40, 2)
    unit = [(n, [x / math.sqrt(sum(y * y for y in v)) for x in v]) for n, v in rows]
    wanted = sorted((-sum(a * b for a, b in zip(unit[0][1], v)), n) for n, v in unit if n)[:20]
    assert [(r.item, round(r.score, 9)) for r in best.orderBy("rank").collect()] == [(n, round(-s, 9)) for s, n in wanted]
