import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from feedloom.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.integers(1, 300), max_size=80))
@settings(max_examples=200, deadline=None)
def test_every_token_has_one_place(sizes):
    at, used = defaultdict(list), defaultdict(list)
    for document, start, length, sequence, offset in packing.assign(sizes, 64):
        at[document].append((start, length))
        used[sequence].append((offset, length))
    for places in (at, used):
        for pieces in places.values():
            pieces.sort()
            assert [s for s, _ in pieces] == [0, *np.cumsum([n for _, n in pieces])[:-1]]
    assert [sum(n for _, n in at[d]) for d in range(len(sizes))] == sizes
    full = [sum(n for _, n in pieces) for pieces in used.values()]
    assert all(x <= 64 for x in full) and len(full) == -(-sum(sizes) // 64)


def test_costs_are_balanced():
    sizes = [50] * 10 + [7] * 100
    costs = defaultdict(float)
    for _, _, length, sequence, _ in packing.assign(sizes, 128):
        costs[sequence] += packing.cost(length)
    assert max(costs.values()) < 1.15 * min(list(costs.values())[:-1])


def check(rows, got):
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r[0]].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == {k for k, _ in rows}
    for key, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[key], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        pieces.sort()
        assert [s for s, _ in pieces] == [0, *np.cumsum([n for _, n in pieces])[:-1]]
        assert sum(n for _, n in pieces) <= 1024
    return by_sequence


def test_query_packs_every_document(spark):
    from conftest import SF_DIR

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = queries.QUERIES["op9_packing"](spark, SF_DIR).collect()
    by_sequence = check(rows, got)
    tokens = sum(r.length for r in got)
    assert tokens > 0.99 * 1024 * len(by_sequence) - 1024 * 8


def test_nulls_and_long_texts(spark):
    rows = [(3, None), (1, ""), (None, "null id"), (2, "word " * 700_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _text int")
    check(rows, packing.packed(docs, PATH).withColumnRenamed("id", "doc_id").collect())


def test_no_documents(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
