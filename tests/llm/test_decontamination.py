import re

import oracle
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedloom.llm import decontamination as dc

DOCS, ITEMS = "doc_id long, text string, items int, words int", "item_id long, text string, length int"


def plain_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def expected(docs, items):
    bench = {}
    for item, text in items:
        w = plain_words(text)
        m = min(13, len(w))
        for i in range(len(w) - m + 1) if m else ():
            bench.setdefault(tuple(w[i : i + m]), set()).add(item)
    out = []
    for key, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for m in {len(x) for x in bench}:
            for i in range(len(w) - m + 1):
                if (at := tuple(w[i : i + m])) in bench:
                    hit |= set(range(i, i + m))
                    found |= bench[at]
        out.append((key, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


def check(spark, docs, items):
    got = dc.contamination(
        spark.createDataFrame([(*d, 1, 1) for d in docs], DOCS), spark.createDataFrame([(*i, 1) for i in items], ITEMS)
    )
    assert sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in got.collect()), key=repr) == expected(docs, items)


def test_documents_as_in_sql(spark):
    oracle.assert_equal(spark, "op5_decontamination")


def test_windows_at_every_place(spark):
    item = " ".join(f"w{i}" for i in range(20))
    run = item.split()
    docs = [(i, " ".join(["x"] * i + run[i : i + 13] + ["y"] * 3)) for i in range(8)]
    docs += [(20, " ".join(run[3:15])), (21, item.upper() + " É " + item), (22, " ".join(run * 3))]
    check(spark, docs, [(1, item), (2, " ".join(run[4:19])), (2, item), (3, "short é one"), (4, "x")])


def test_nulls_repeats_and_long_texts(spark):
    item = "a b c d e f g h i j k l m n"
    docs = [(1, None), (None, item), (None, item), (2, ""), (3, "-- !"), (4, "a " * 50_000 + item), (4, "other")]
    check(spark, docs, [(7, item), (7, item), (8, None), (9, " ."), (None, "other"), (5, "a " * 30)])


def test_empty_tables(spark):
    check(spark, [], [(1, "a b")])
    check(spark, [(1, "a b")], [])


@given(st.lists(st.text("ab ", max_size=60), max_size=5), st.lists(st.text("ab ", max_size=40), max_size=4))
@settings(max_examples=6, deadline=None)
def test_repetitive_texts(spark, docs, items):
    check(spark, list(enumerate(docs)), list(enumerate(items)))


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a", 1, 1)], DOCS)
    told = dc.contamination(docs, spark.createDataFrame([(1, "a", 1)], ITEMS)).select(F.col("n_hit"))
    assert "Python" not in told._jdf.queryExecution().toString() and "Arrow" not in told._jdf.queryExecution().toString()
