import heapq
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from feedloom.llm import huffman, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_cost(counts):
    """Bits of an unlimited Huffman code."""
    heap, total = sorted(counts), 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


@given(st.lists(st.integers(0, 10**9), min_size=2, max_size=60))
@settings(max_examples=100, deadline=None)
def test_lengths_are_optimal_and_limited(counts):
    counts = np.array(counts)
    if (counts > 0).sum() < 2:
        return
    free, tight = huffman.code_lengths(counts, 40).astype(int), huffman.code_lengths(counts, 6).astype(int)
    assert (free * counts).sum() == plain_cost([c for c in counts.tolist() if c])
    assert tight.max() <= 6 and (tight * counts).sum() >= (free * counts).sum()
    for lengths in (free, tight):
        assert sum(0.5**x for x in lengths if x) == 1
        assert all(x > 0 for x, c in zip(lengths, counts) if c)


@given(st.lists(st.integers(0, 300), min_size=1, max_size=2000))
@settings(max_examples=100, deadline=None)
def test_packed_ids_come_back(ids):
    ids = np.array(ids)
    lengths = huffman.code_lengths(np.bincount(ids), 12)
    data, checks = huffman.pack(ids, lengths, huffman.canonical(lengths))
    symbols, steps = huffman.look_up(lengths, 12)
    assert np.array_equal(huffman.unpack(data, checks, len(ids), symbols, steps, 12), ids)


def expected(rows):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_plain_encoding(spark):
    from conftest import SF_DIR

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = queries.QUERIES["op2_token_output"](spark, SF_DIR)
    assert got.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected(rows))


def test_nulls_long_texts_and_blocks(spark, monkeypatch):
    rows = [(3, None, 0), (1, "", 0), (None, "null id", 0), (2, "word " * 400_000, 0), (9, "same", 0), (9, "same", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _ids int")
    got = huffman.round_trip(docs, PATH, keep_ids=True).collect()
    assert sorted(map(str, [tuple(r)[:4] for r in got])) == sorted(map(str, expected([r[:2] for r in rows])))
    long = next(r for r in got if r.id == 2)
    assert len(long.ids) == 400_001 > huffman.BLOCK_IDS and set(long.ids[:-1]) == {long.ids[0]}


def test_no_documents(spark):
    assert huffman.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_cut_files_are_seen():
    with pytest.raises(ValueError):
        list(huffman._file_blocks(memoryview(b"HUFF" + bytes(16) + b"x")))
