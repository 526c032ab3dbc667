import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedloom.llm import queries
from feedloom.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, _bytes int, _gram int"


def expected(rows, length):
    """By counting every string."""
    data = [(k, (t or "").encode()) for k, t in rows]
    count = Counter(d[i : i + length] for _, d in data for i in range(len(d) - length + 1))
    out = []
    for key, d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone[: len(d)]])
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((key, len(d), len(d) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows, length=sd.LENGTH):
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    got = sd.without_repeats(docs, length=length).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(rows, length)


@given(st.lists(st.integers(0, 3), max_size=60))
@settings(max_examples=500, deadline=None)
def test_suffixes_are_sorted(symbols):
    symbols = [x + 1 for x in symbols] + [0]
    assert sd.suffix_order(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@given(st.lists(st.integers(0, 50), min_size=1, max_size=100), st.integers(1, 100))
@settings(max_examples=100, deadline=None)
def test_sliding_least(values, width):
    width = min(width, len(values))
    got = sd.sliding_least(np.array(values, np.uint64), width)
    assert got.tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


def test_query_equals_counting(spark):
    from conftest import SF_DIR

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = queries.QUERIES["op4_suffix_dedup"](spark, SF_DIR).collect()
    want = expected(rows, 200)
    assert sorted((tuple(r) for r in got), key=repr) == want and sum(r[2] > 0 for r in want) > 5


def mixed(seed, n, alphabet="abcdefgh "):
    own = random.Random(seed)
    pool = ["".join(own.choices(alphabet, k=own.randrange(5, 60))) for _ in range(12)]
    return [(i, "".join(own.choice(pool) if own.random() < 0.5 else "".join(own.choices(alphabet, k=9)) for _ in range(own.randrange(12)))) for i in range(n)]


@pytest.mark.parametrize("length", [20, 24, 31])
def test_shared_passages(spark, length):
    check(spark, mixed(length, 60), length)


def test_groups_dealt_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(sd, "GROUP_SEGMENTS", 3)
    monkeypatch.setattr(sd, "BATCH", 500)
    check(spark, mixed(7, 80), 24)


def test_periodic_texts_and_slices(spark, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK", 300)
    own = random.Random(3)
    long = "".join(own.choices("abc", k=2000))
    check(spark, [(1, "ab" * 200), (2, "a" * 450), (3, "abc" * 33), (4, long), (5, "x" + long[700:1400] + "y"), (6, "b" + "a" * 450)], 40)


def test_nulls_short_and_repeated_rows(spark):
    text = "".join(random.Random(1).choices("abcdef é", k=400))
    check(spark, [(1, None), (2, ""), (3, "short"), (4, text[:199]), (5, text), (5, text), (None, text[100:350]), (None, None), (6, "z" + text[201:])])


def test_no_documents(spark):
    check(spark, [])
