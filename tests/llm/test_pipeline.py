import random
import re

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F
from test_decontamination import expected as benchmark_words
from test_line_dedup import expected as without_lines
from test_packing import check as check_packing

import corpus_pipeline as cp
from feedloom.llm import order_minhash as om

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    assert df.columns == COLUMNS
    return [tuple(r) for r in df.collect()]


def near_classes(rows):
    """Roots by comparing all pairs."""
    shingles = om.Shingles()
    found = [shingles(shingles.words(t or "")) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(found):
        for j in range(i):
            if len(a) and om.matched(a, found[j], 0.8):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))]


def follow(spark, docs, folder, items):
    """Run all stages over written tables and hold each against a plain version."""
    path = f"{folder}/documents.parquet"
    docs.write.parquet(path)
    items.write.parquet(f"{folder}/benchmark.parquet")
    bench = [(r.item_id, r.text) for r in items.collect()]
    for name, stage in cp.STAGES:
        before = spark.read.parquet(path)
        old = sorted(rows_of(before), key=lambda r: (r[0] is None, r[0] or 0))
        made = stage(spark, before, folder)
        made.write.parquet(f"{folder}/{name}")
        path = f"{folder}/{name}"
        made = spark.read.parquet(path)
        if name == "packing":
            check_packing([(r[0], r[1]) for r in old], made.collect())
            assert made.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return old
        new = rows_of(made)
        if name == "language_id":
            gone = set(old) - set(new)
            assert set(new) <= set(old) and {r for r in old if not re.search(r"[^\W\d_]", r[1] or "")} <= gone
            assert len(gone) <= 0.02 * len(old) + sum(not re.search(r"[^\W\d_]", r[1] or "") for r in old)
        elif name == "line_dedup":
            texts = without_lines([r[:2] for r in old])
            want = [(*r[:1], texts[r[:2]], *r[2:4], len(texts[r[:2]])) for r in old]
            assert sorted(new, key=repr) == sorted([r for r in want if r[1].split()], key=repr)
        elif name == "minhash_dedup":
            roots = near_classes([r[:2] for r in old])
            assert sorted(new, key=repr) == sorted([old[i] for i in sorted(set(roots))], key=repr)
        elif name == "decontamination":
            bad = {k for k, n, hit, _ in benchmark_words([r[:2] for r in old], bench) if hit and 20 * hit >= n}
            assert sorted(new, key=repr) == sorted([r for r in old if r[0] not in bad], key=repr)


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    follow(spark, docs, str(tmp_path / "x"), spark.read.parquet(f"{SF_DIR}/benchmark.parquet"))


def test_planted_cases(spark, tmp_path):
    own = random.Random(4)
    word = lambda: "".join(own.choices("etaoinshr", k=own.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    item, base, twice = text(40), text(300), text(80)
    near = base.split()
    near[150] = "changed"
    rows = [(1, base), (2, " ".join(near[:100]) + "\n" + " ".join(near[100:])), (3, text(100) + " " + item), (4, text(50)),
            (5, None), (6, ""), (7, "123"), (8, twice), (8, twice), (None, text(60)), (9, "line\n" + text(30)), (10, "line\n" + text(20))]
    rows += [(r, t) for r, t in [(11, rows[3][1])]]
    data = [(k, t, "en", "s", len(t or "")) for k, t in rows]
    items = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    left = follow(spark, spark.createDataFrame(data, SCHEMA), str(tmp_path / "x"), items)
    assert sorted((r[0] for r in left), key=repr) == sorted([1, 4, 8, None, 9, 10], key=repr)


def test_run_gives_the_last_stage(spark):
    got = cp.run(spark, SF_DIR)
    assert got.columns[:2] == ["doc_id", "start"] and got.count() > 0


def test_implausible_texts_go_and_clean_ones_stay(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select(*COLUMNS)
    own = random.Random(5)
    junk = " ".join("".join(own.choices("abcdefghijklmnopqrstuvwxyz", k=own.randrange(3, 10))) for _ in range(60))
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto"
    greek = "όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα"
    more = spark.createDataFrame([(-k, t, None, "s", len(t)) for k, t in enumerate([junk, finnish, greek], 1)], SCHEMA)
    left = {r.doc_id for r in cp.language_id(spark, docs.union(more.select(docs.columns)), SF_DIR).collect()}
    assert left == {r.doc_id for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")}


@pytest.mark.parametrize("stage", cp.STAGES, ids=lambda s: s[0])
def test_no_documents(spark, stage):
    assert stage[1](spark, spark.createDataFrame([], SCHEMA), SF_DIR).count() == 0


CLASHING = ["_id", "_key", "_gone", "_edits", "_n_exact", "_n_edited", "_n_lines", "_language", "_share", "_plausible", "_read_text", "_r__id", "_text", "_first"]


@pytest.mark.parametrize("stage", cp.STAGES[:-1], ids=lambda s: s[0])
def test_columns_of_any_name_are_kept(spark, stage):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select(*COLUMNS)
    more = docs.withColumns({c: F.concat(F.lit(c), "doc_id") for c in CLASHING})
    got = stage[1](spark, more, SF_DIR)
    assert got.columns == [*COLUMNS, *CLASHING]
    got = got.collect()
    want = stage[1](spark, docs, SF_DIR).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == sorted(map(tuple, want))
    assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in CLASHING)


def test_of_rows_that_differ_in_other_columns_the_first_stays(spark):
    text = " ".join(f"w{k}" for k in range(40))
    data = [(1, text, "en", s, 9) for s in ("b", "a", "c")]
    for order in (data, data[::-1]):
        assert [tuple(r) for r in cp.near_copies(spark, spark.createDataFrame(order, SCHEMA), SF_DIR).collect()] == [(1, text, "en", "a", 9)]
