import random

import oracle
import pytest
from pyspark.sql import functions as F

from feedloom.llm import line_dedup

SCHEMA = "doc_id long, text string, _line int, key int"


def edits(a, b):
    """Word edit distance, up to 2."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j - 1] + (x != y), before[j] + 1, row[-1] + 1))
    return row[-1]


def expected(rows):
    """Texts by id and text, compared pair by pair."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = [], {}
    for key, text in order:
        kept = []
        for line in (text or "").split("\n"):
            w = line.split()
            near = [v for v in seen if v == w or (min(len(v), len(w)) >= 10 and abs(len(v) - len(w)) <= 1 and edits(v, w) <= 1)]
            if not w or not near:
                kept.append(line)
            if w:
                seen.append(w)
        out[key, text] = None if text is None else "\n".join(kept)
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA).withColumnRenamed("key", "before")
    docs = docs.selectExpr("doc_id", "text", "text AS old", "_line", "before")
    got = line_dedup.without_seen_lines(docs).collect()
    assert len(got) == len(rows)
    want = expected(rows)
    assert {(r.doc_id, r.old): r.text for r in got} == want
    for r in got:
        assert r._n_lines - r._n_exact - r._n_edited == (0 if r.text is None else 0 if r.text == "" and r._n_exact + r._n_edited else len(r.text.split("\n")))


def test_documents_as_in_sql(spark):
    oracle.assert_equal(spark, "op1_line_dedup")


@pytest.mark.parametrize("size", [10, 11, 19, 20, 21, 39, 40, 41, 99, 100, 101, 150])
def test_edits_at_every_place(spark, size):
    own = random.Random(size)
    base = [f"w{own.randrange(10**6)}" for _ in range(size)]
    rows = [(0, " ".join(base))]
    for i in sorted(own.sample(range(size), min(size, 8)) + [0, size - 1]):
        rows += [(len(rows), " ".join([*base[:i], "new", *base[i + 1 :]])), (len(rows) + 1, " ".join([*base[:i], *base[i + 1 :]])),
                 (len(rows) + 2, " ".join([*base[:i], f"in{i}", *base[i:]])), (len(rows) + 3, " ".join([*base[:i], "p", "q", *base[i + 1 :]]))]
    check(spark, rows)


def test_repetitive_lines(spark):
    own = random.Random(1)
    check(spark, [(i, "\n".join(" ".join(own.choices("ab", [9, 1], k=own.randrange(9, 14))) for _ in range(3))) for i in range(40)])


def test_nulls_blanks_and_repeated_rows(spark):
    line = "one two three four five six seven eight nine ten"
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, f" {line} \n\nshort\nshort\n{line}"), (7, "short\nother"), (5, "x\ny"), (5, "x\ny"),
            (None, f"{line} eleven\nnew"), (None, None), (6, "word " * 3000 + "\n" + "word " * 3001)]
    docs = spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in line_dedup.without_seen_lines(docs).collect()), key=repr)
    want = [(1, None), (2, ""), (3, "\n\n"), (4, f" {line} \n\nshort"), (7, "other"), (5, "x\ny"), (5, "x\ny"), (None, "new"), (None, None), (6, "word " * 3000)]
    assert got == sorted(want, key=repr)


def test_no_documents(spark):
    assert line_dedup.without_seen_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = line_dedup.without_seen_lines(spark.createDataFrame([(1, "a", 1, 1)], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_columns_of_any_name_are_kept(spark):
    line = "one two three four five six seven eight nine ten"
    rows = [(1, f"{line}\nshort"), (2, f"{line} eleven\nshort\nnew"), (None, None)]
    extra = {"_id": F.lit("i"), "_key": F.lit("k"), "_KEY_": F.lit("K"), "_gone": F.lit("g"), "_edits": F.lit("e"), "_r__id": F.lit("r"), "_place": F.lit("p")}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(extra).withColumn("_n_exact", F.lit("replaced"))
    got = line_dedup.without_seen_lines(docs)
    assert set(got.columns) == {*docs.columns, "_n_lines", "_n_edited"}
    told = {r.doc_id: r for r in got.collect()}
    assert {k: (r.text, r["_n_lines"], r["_n_exact"], r["_n_edited"]) for k, r in told.items()} == {
        1: (f"{line}\nshort", 2, 0, 0), 2: ("new", 3, 1, 1), None: (None, 0, 0, 0)}
    assert all([r[c] for c in extra] == list("ikKgerp") for r in told.values())


def test_words_of_wanted_lines_alone_are_cut(spark):
    from pyspark.sql import functions as F

    rows = [(1, 7, " a\tb \n\nc d"), (1, 7, " a\tb \n\nc d"), (None, 8, "e  f"), (2, 9, "g")]
    docs = spark.createDataFrame(rows, "_id LONG, _key LONG, _text STRING")
    every = line_dedup.lines(docs).withColumn("_place", line_dedup.place())
    wanted = every.where("_words[0] <> 'g'").select(*line_dedup.LINE, "_place").distinct()
    got = line_dedup._with_words(docs, wanted)
    assert sorted((r._words, r._place._line) for r in got.collect()) == [(["a", "b"], 0), (["c", "d"], 2), (["e", "f"], 0)]
    assert got.join(every.select(*line_dedup.LINE, F.col("_words").alias("_w")).distinct(), line_dedup.LINE).where("_w <> _words").isEmpty()
