"""Token ids as canonical Huffman codes in files of independent blocks.

Writing: texts are encoded once; the ids are counted over the whole corpus
(per task, then summed), from which the driver makes code lengths, at most one
per id of the vocabulary. The rows are range-partitioned by document id and each
partition becomes one file, in order: a header with the code lengths, then
blocks. A block has a fixed number of ids, so a long document goes on in the next
one; it holds the bit offset of every CHECK-th id, from which it is decoded in
parallel by table look-ups. Blocks go through Spark's committed text writer,
which puts a fixed end mark after each.

Reading: block heads give the ids before each file; decoding a block needs
nothing but the file's header.

Edge cases: a null text is empty and gets only the end id. Null ids come first.
Rows of one id are ordered by their ids, so repeated rows follow each other. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.llm import common, tokens
from feedloom.operators import scale

MAX_BITS = 18
BLOCK_IDS = 1 << 18
CHECK = 128
END_MARK = b"\r\nEND-OF-BLOCK\r\n"
_FILE, _BLOCK = b"HUFF", b"BLCK"
# Of a block: file number, ids of the file before it, ids, parts of documents, bytes of codes.
_HEAD = "<qqqqq"
# Of a part of a document: id, whether it has one, ids of it before the block, ids here, whether it ends here.
_PART = np.dtype([("id", "<i8"), ("has_id", "u1"), ("before", "<i8"), ("n", "<i8"), ("ends", "u1")])


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code length per symbol, at most ``max_bits``; 0 where the count is 0.

    Package-merge: at each of ``max_bits`` levels the symbols and the pairs of the
    level below are merged by weight; the cheapest 2n - 2 of the top level say
    how often each symbol is taken, which is its length.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols need more than {max_bits} bits")
    if n <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    leaf_at, level = [], weights
    for _ in range(max_bits):
        merged = np.argsort(level, kind="stable") if leaf_at else np.arange(n)
        if leaf_at:
            level = level[merged]
        leaf_at.append(merged < n)
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        level = np.concatenate([weights, pairs])
    taken = 2 * n - 2
    for leaves in reversed(leaf_at):
        symbols = int(leaves[:taken].sum())
        lengths[order[:symbols]] += 1
        taken = 2 * (taken - symbols)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    code, before = 0, int(lengths[order[0]]) if len(order) else 0
    for symbol, bits in zip(order.tolist(), lengths[order].tolist()):
        code <<= bits - before
        codes[symbol] = code
        code, before = code + 1, bits
    return codes


def look_up(lengths: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for each ``max_bits`` bits that may follow."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    times = np.int64(1) << (max_bits - lengths[order].astype(np.int64))
    rest = (1 << max_bits) - int(times.sum())
    symbols = np.concatenate([np.repeat(order, times), np.zeros(rest, np.int64)]).astype(np.uint32)
    return symbols, np.concatenate([np.repeat(lengths[order], times), np.ones(rest, np.uint8)]).astype(np.int64)


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Codes of the ids, first bit first, and the bit offset of every CHECK-th."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    at = ends - bits
    shifted = codes[ids] << (64 - (at & 31) - bits).astype(np.uint64)
    word = at >> 5
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words = np.zeros(int(word[-1]) + 2, np.uint64)
    words[word[first]] += np.add.reduceat(shifted >> np.uint64(32), first)
    words[word[first] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], at[::CHECK].astype("<u4")


def unpack(data: bytes, checks: np.ndarray, n: int, symbols: np.ndarray, lengths: np.ndarray, max_bits: int) -> np.ndarray:
    """The n ids: one lane per checkpoint, all lanes a step at a time."""
    raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at = checks.astype(np.int64)
    out = np.zeros((CHECK, len(at)), np.uint32)
    mask, last = (1 << max_bits) - 1, len(window) - 1
    for step in range(CHECK):
        left = window[np.minimum(at >> 3, last)].astype(np.int64) >> (32 - max_bits - (at & 7))
        left &= mask
        out[step] = symbols[left]
        at += lengths[left]
    return out.T.ravel()[:n]


def encoded(docs: DataFrame, id: str, text: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Columns ``_id``, ``_ids`` (little-endian words) of whole texts with the end id."""
    file = tokens.shipped(docs.sparkSession, tokenizer_path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        encoder = tokens.encoder(file.value)
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in batches:
            for part in common.sliced(batch, 128):
                texts = [x or "" for x in part.column("_text").to_pylist()]
                yield {"_id": part.column("_id"), "_ids": [encoder(x).tobytes() + end for x in texts]}

    rows = docs.select(F.col(id).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    return common.arrow_map(rows, encode, "_id bigint, _ids binary")


def id_counts(encoded: DataFrame, width: int) -> np.ndarray:
    """How often each id occurs in all rows; as long as the largest id demands."""
    kind = np.dtype(f"<u{width}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in common.sliced(batch, 2048):
                found = np.bincount(np.frombuffer(b"".join(part.column("_ids").to_pylist()), kind)).astype(np.int64)
                if len(found) > len(total):
                    total, found = found, total
                total[: len(found)] += found
        used = np.flatnonzero(total)
        yield {"id": used, "n": total[used]}

    sums = common.arrow_map(encoded.select("_ids"), count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    told = sums.toPandas()
    counts = np.zeros(int(told["id"].max()) + 1 if len(told) else 0, np.int64)
    counts[told["id"].to_numpy(np.int64)] = told["n"].to_numpy(np.int64)
    return counts


def write_ids(encoded: DataFrame, path: str, counts: np.ndarray, width: int, max_bits: int = MAX_BITS) -> None:
    """Write rows of ``encoded`` in ascending id order, a file per partition."""
    kind, lengths = np.dtype(f"<u{width}"), code_lengths(counts, max_bits)
    packed_lengths = zlib.compress(lengths.tobytes())
    spark = encoded.sparkSession
    table = spark.sparkContext.broadcast(packed_lengths)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        held = table.value
        lengths = np.frombuffer(zlib.decompress(held), np.uint8)
        codes, number = canonical(lengths), TaskContext.get().partitionId()
        yield {"block": [_FILE + struct.pack("<qq", max_bits, len(held)) + held]}
        parts, pieces, filled, done = [], [], 0, 0

        def block() -> dict[str, list]:
            ids = np.concatenate(pieces)
            data, checks = pack(ids, lengths, codes)
            head = struct.pack(_HEAD, number, done, len(ids), len(parts), len(data))
            return {"block": [_BLOCK + head + np.array(parts, _PART).tobytes() + checks.tobytes() + data]}

        for batch in batches:
            for key, value in zip(batch.column("_id").to_pylist(), batch.column("_ids")):
                ids, at = np.frombuffer(value.as_buffer(), kind), 0
                while at < len(ids):
                    n = min(len(ids) - at, BLOCK_IDS - filled)
                    parts.append((key or 0, key is not None, at, n, at + n == len(ids)))
                    pieces.append(ids[at : at + n].copy())
                    at, filled = at + n, filled + n
                    if filled == BLOCK_IDS:
                        yield block()
                        parts, pieces, filled, done = [], [], 0, done + filled
        if filled:
            yield block()

    n = max(1, scale.shuffle_partitions(spark))
    placed = encoded.repartitionByRange(n, F.col("_id").asc_nulls_first()).sortWithinPartitions(
        F.col("_id").asc_nulls_first(), "_ids"
    )
    (
        common.arrow_map(placed, blocks, "block binary")
        .select(F.col("block").cast("string").alias("value"))
        .write.option("lineSep", END_MARK.decode())
        .text(path)
    )


def _file_blocks(data: memoryview) -> Iterator[tuple[bytes, tuple, memoryview]]:
    """(kind, head, rest) of what a file is made of."""
    at = 0
    while at < len(data):
        kind = bytes(data[at : at + 4])
        at += 4
        if kind == _FILE:
            head = struct.unpack_from("<qq", data, at)
            at += 16
            size = head[1]
        elif kind == _BLOCK:
            head = struct.unpack_from(_HEAD, data, at)
            at += struct.calcsize(_HEAD)
            size = head[3] * _PART.itemsize + (head[2] + CHECK - 1) // CHECK * 4 + head[4]
        else:
            raise ValueError("not a file of Huffman blocks")
        yield kind, head, data[at : at + size]
        at += size
        if bytes(data[at : at + len(END_MARK)]) != END_MARK:
            raise ValueError("a block is cut off")
        at += len(END_MARK)


def read_ids(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """A row per document: id, start (ids of all documents before it), n_tokens,
    ids_crc32 of the ids as little-endian 32-bit words, and the ids if asked for."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            for content in batch.column("content"):
                heads = [h for k, h, _ in _file_blocks(memoryview(content.as_buffer())) if k == _BLOCK]
                yield {"_file": [h[0] for h in heads], "_n": [h[2] for h in heads]}

    totals = common.arrow_map(files, sizes, "_file bigint, _n bigint").groupBy("_file").agg(F.sum("_n").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    # One row per file, of which there are as many as shuffle partitions.
    offsets = F.broadcast(totals.select("_file", F.coalesce(before, F.lit(0)).alias("_offset")))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        names = ["_file", "_at", "id", "n_tokens", "ids_crc32", *["ids"] * keep_ids]
        for batch in batches:
            for content in batch.column("content"):
                crc, kept = 0, []
                for kind, head, rest in _file_blocks(memoryview(content.as_buffer())):
                    if kind == _FILE:
                        max_bits = head[0]
                        lengths = np.frombuffer(zlib.decompress(rest), np.uint8)
                        symbols, steps = look_up(lengths, max_bits)
                        continue
                    number, done, n, n_parts, size = head
                    parts = np.frombuffer(rest[: n_parts * _PART.itemsize], _PART)
                    checks = np.frombuffer(rest[n_parts * _PART.itemsize : len(rest) - size], "<u4")
                    ids = unpack(bytes(rest[len(rest) - size :]), checks, n, symbols, steps, max_bits).astype("<u4", copy=False)
                    out, at = {x: [] for x in names}, 0
                    for key, has, earlier, m, ends in parts.tolist():
                        crc = zlib.crc32(ids[at : at + m], crc)
                        if keep_ids:
                            kept.append(ids[at : at + m])
                        at += m
                        if ends:
                            row = [number, done + at - m - earlier, key if has else None, earlier + m, crc]
                            for x, v in zip(names, [*row, *([np.concatenate(kept)] if keep_ids else [])]):
                                out[x].append(v)
                            crc, kept = 0, []
                    yield out

    schema = "_file bigint, _at bigint, id bigint, n_tokens bigint, ids_crc32 bigint"
    rows = common.arrow_map(files, decode, schema + (", ids array<bigint>" if keep_ids else ""))
    start = (F.col("_at") + F.col("_offset")).alias("start")
    return rows.join(offsets, "_file").select("id", start, "n_tokens", "ids_crc32", *["ids"] * keep_ids)


def round_trip(
    docs: DataFrame, tokenizer_path: str, id: str = "doc_id", text: str = "text", end_id: int = 1, keep_ids: bool = False
) -> DataFrame:
    """Encode all texts, write the ids to the shared folder and read them back."""
    spark = docs.sparkSession
    width = tokens.Encoder(tokens.shipped(spark, tokenizer_path).value).kind.itemsize
    rows = scale.stage(encoded(docs, id, text, tokenizer_path, end_id))
    path = scale.new_path(spark, "ids")
    write_ids(rows, path, id_counts(rows, width), width)
    return read_ids(spark, path, keep_ids)
