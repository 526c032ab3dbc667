"""Repeated substrings of a corpus, found by sorting suffixes.

A byte goes if it lies in a string of LENGTH bytes that starts anywhere else too.

1. Every string of LENGTH bytes picks an anchor, the GRAM bytes of least hash in
   it (the leftmost of equal ones). Equal strings pick equal grams at equal
   places, so only strings of one anchor gram can be equal. Neighbouring strings
   share their anchor; together they are a segment.
2. Grams that occur once in the corpus are done. Equal segments of the others are
   counted; all strings of a segment that occurs twice go. What remains are the
   different segments of one gram, each once.
3. These are cut into blocks of BLOCK bytes counted from the anchor, so equal
   strings are cut equally, and the suffixes of the block sequences are sorted.
   Runs of neighbours in that order that agree in all blocks of a string are
   exactly the candidates; the few bytes before and after the blocks decide.
4. The spans return to all copies of their segments, and so to the documents.

Suffix sorting is the linear grouping construction: groups of suffixes with equal
Lyndon prefixes are refined from the highest to the lowest by pointers to the
previous suffix of a lower group; then every group's order is emitted from the
left along the same pointers.

A group of segments goes to one task if it has at most GROUP_SEGMENTS. A larger
one is dealt over several: each of its strings picks a second anchor, by another
hash, segments are cut where that changes, and the pieces are dealt by the second
gram. Equal strings agree in both anchors, so they meet in one part.

Edge cases: null and empty texts have no bytes. Repeated rows repeat each other.
Texts are worked through in slices of CHUNK bytes that overlap by a string. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm import common
from feedloom.operators import scale

LENGTH = 200
GRAM = 64
BLOCK = 8
CHUNK = 1 << 20
MOST_LENGTH = 1 << 16
GROUP_SEGMENTS = 2048
BATCH = 1 << 18
# Rows of 8 bytes that may be broadcast.
BROADCAST_GRAMS = 2_000_000
SEGMENT = ["_gram", "_h1", "_h2"]

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


@functools.cache
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    n = CHUNK + MOST_LENGTH + 1
    both = []
    for x in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n, x, np.uint64)
        steps[0] = 1
        both.append(np.cumprod(steps))
    return both[0], both[1]


class Hashes:
    """Polynomial hashes of any substring of some bytes."""

    def __init__(self, data: np.ndarray, base: int = _BASES[0]):
        powers, self.inverse = _powers(base)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.inverse[start]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window, from prefix and suffix minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, length: int, gram: int, by: int = _BASES[0]) -> Iterator[tuple[np.ndarray, ...]]:
    """(gram, anchor, first, last string start, two hashes) of each segment; the
    hash that chooses anchors is that of the base ``by``."""
    for base in range(0, len(data) - length + 1, CHUNK):
        part = data[base : base + CHUNK + length - 1]
        hashes = Hashes(part, by)
        at = np.arange(len(part) - gram + 1)
        grams = hashes(at, at + gram)
        # The gram's hash above, its place below: the leftmost of equal hashes is least.
        bits = np.uint64(21)
        least = sliding_least((grams >> bits << bits) | at.astype(np.uint64), length - gram + 1)
        anchor = (least & np.uint64((1 << 21) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.append(first[1:], len(anchor)) - 1
        found = anchor[first]
        one, two = hashes(first, last + length), Hashes(part, _BASES[1])(first, last + length)
        yield grams[found], found + base, first + base, last + base, one, two


def suffix_order(symbols: list[int]) -> list[int]:
    """Suffix array of symbols of which the last is the least and unique."""
    n = len(symbols)
    members: list[list[int]] = []
    number: dict[int, int] = {}
    for symbol in sorted(set(symbols)):
        number[symbol] = len(members)
        members.append([])
    group = [number[x] for x in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    previous, done = [-1] * n, bytearray(n)
    g = len(members) - 1
    while g >= 0:
        pointed: dict[int, int] = {}
        for i in members[g]:
            if group[i] != g:
                continue  # it was put into a higher group
            done[i] = 1
            j = i - 1
            while j >= 0 and done[j]:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if pointed:
            parts: dict[tuple[int, int], list[int]] = {}
            for j in sorted(pointed):
                parts.setdefault((-pointed[j], group[j]), []).append(j)
            for (_, old), moved in sorted(parts.items()):
                new, after = len(members), above[old]
                members.append(moved)
                for j in moved:
                    group[j] = new
                below.append(old)
                above.append(after)
                above[old] = new
                if after >= 0:
                    below[after] = new
        g = below[g]
    sizes = [0] * len(members)
    for g in group:
        sizes[g] += 1
    g = 0
    while below[g] >= 0:
        g = below[g]
    free, at = [0] * len(members), 0
    while g >= 0:
        free[g] = at
        at += sizes[g]
        g = above[g]
    order, placed = [-1] * n, bytearray(n)
    order[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = previous[j]
    return order


def repeated_strings(segments: list[bytes], anchor: np.ndarray, strings: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(segment, start, class) of every string of ``length`` bytes that could be
    equal to another one of the segments; equal ones have equal classes.

    ``anchor`` is each segment's anchor in it, ``strings`` how many strings it has.
    """
    lead = anchor % BLOCK  # bytes before the first block
    blocks = [(len(s) - d) // BLOCK for s, d in zip(segments, lead.tolist())]
    words = [np.frombuffer(s, ">u8", b, d) for s, b, d in zip(segments, blocks, lead.tolist())]
    _, ranks = np.unique(np.concatenate(words), return_inverse=True)
    m = len(segments)
    sizes = np.array(blocks) + 1
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(m), sizes)
    inside = np.arange(len(owner)) - begin[owner]
    symbols = np.zeros(len(owner), np.int64)
    ends = inside == sizes[owner] - 1
    symbols[~ends] = ranks + m + 1
    symbols[ends] = np.arange(m) + 1  # each end its own symbol, so that no match crosses it
    order = np.array(suffix_order([*symbols.tolist(), 0])[1:], np.int64)
    full = length // BLOCK - 1  # blocks that every string has whole
    # Neighbours in suffix order that agree in so many symbols.
    padded = np.concatenate([symbols, -np.arange(1, full + 1)])
    alike = np.arange(1, len(order))
    for step in range(full):
        alike = alike[padded[order[alike] + step] == padded[order[alike - 1] + step]]
    joined = np.zeros(len(order) + 1, bool)
    joined[alike] = True
    member = joined[:-1] | joined[1:]
    classes = np.cumsum(~joined[:-1])[member]
    place = order[member]
    segment = owner[place]
    block_start = lead[segment] + inside[place] * BLOCK
    text = np.frombuffer(b"".join(segments), np.uint8)
    offset = np.concatenate([[0], np.cumsum([len(s) for s in segments])[:-1]])
    found = []
    for before in range(BLOCK):
        start = block_start - before
        good = np.flatnonzero((start >= 0) & (start < strings[segment]))
        own, at = segment[good], start[good]
        edge = np.zeros((len(good), 2 * BLOCK), np.uint8)
        for k in range(length - full * BLOCK):
            shift = k if k < before else full * BLOCK + k
            edge[:, k] = text[offset[own] + at + shift]
        key = np.column_stack([classes[good], np.full(len(good), before), edge.view(np.int64)])
        found.append((own, at, key))
    own, at, key = (np.concatenate(x) for x in zip(*found))
    if not len(own):
        return own, at, np.zeros(0, np.int64)
    _, number = np.unique(key, axis=0, return_inverse=True)
    return own, at, number.ravel()


def segments_of(rows: DataFrame, length: int, gram: int, only_grams: bool) -> DataFrame:
    """Segments of each text: gram, and unless ``only_grams`` where it is."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            for part in common.sliced(batch, 256):
                found, row = [], []
                for n, value in enumerate(part.column("_bytes")):
                    data = np.frombuffer(value.as_buffer() or b"", np.uint8)
                    if len(data) >= length:
                        for x in anchors(data, length, gram):
                            found.append(x)
                            row.append(np.full(len(x[0]), n))
                if not found:
                    continue
                grams, anchor, first, last, one, two = (np.concatenate(x) for x in zip(*found))
                if only_grams:
                    yield {"_gram": grams.view(np.int64)}
                    continue
                row = pa.array(np.concatenate(row))
                yield {
                    "_gram": grams.view(np.int64), "_h1": one.view(np.int64), "_h2": two.view(np.int64),
                    "_id": part.column("_id").take(row), "_key": part.column("_key").take(row),
                    "_first": first, "_strings": (last - first + 1).astype(np.int32), "_anchor": (anchor - first).astype(np.int32),
                }

    columns = "_gram bigint"
    if not only_grams:
        columns += ", _h1 bigint, _h2 bigint, _id bigint, _key bigint, _first bigint, _strings int, _anchor int"
    return common.arrow_map(rows if not only_grams else rows.select("_bytes"), find, columns)


def cut_out(rows: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """The bytes of the wanted segments, read from one document each; segments of
    several parts cut into pieces, which begin ``_base`` bytes after them."""
    per_doc = wanted.groupBy("_id", "_key").agg(
        F.collect_list(F.struct(*SEGMENT, "_first", "_strings", "_anchor", "_parts", "_whole")).alias("_wanted")
    )
    held = common.join_on(rows, per_doc, ["_id", "_key"], "inner")
    names = [*SEGMENT, "_strings", "_anchor", "_whole", "_part", "_base", "_bytes"]

    def pieces(data: memoryview, parts: int) -> Iterator[tuple[int, int, int]]:
        """(part, first, last string start) of each piece of a segment."""
        if parts == 1:
            yield 0, 0, len(data) - length
            return
        for grams, _, first, last, _, _ in anchors(np.frombuffer(data, np.uint8), length, gram, _BASES[1]):
            yield from zip((grams % np.uint64(parts)).tolist(), first.tolist(), last.tolist())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            for part in common.sliced(batch, 64):
                out: dict[str, list] = {x: [] for x in names}
                for value, segments in zip(part.column("_bytes"), part.column("_wanted").to_pylist()):
                    data = memoryview(value.as_buffer())
                    for s in segments:
                        whole = data[s["_first"] : s["_first"] + s["_strings"] + length - 1]
                        for number, first, last in pieces(whole, s["_parts"]):
                            row = [*(s[x] for x in SEGMENT), last - first + 1, s["_anchor"] - first, s["_whole"], number, first]
                            for x, v in zip(names, [*row, bytes(whole[first : last + length])]):
                                out[x].append(v)
                yield out

    schema = "_gram bigint, _h1 bigint, _h2 bigint, _strings int, _anchor int, _whole boolean, _part int, _base int, _bytes binary"
    return common.arrow_map(held.select("_bytes", "_wanted"), cut, schema)


def sorted_segments(segments: DataFrame, length: int) -> DataFrame:
    """Runs of repeated strings of the segments of each (gram, part)."""
    dealt = segments.repartition("_gram", "_part").sortWithinPartitions("_gram", "_part", "_h1", "_h2", "_base")
    names = [*SEGMENT, "_from", "_to"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        held: list[dict] = []
        size = 0

        def run() -> dict[str, list]:
            anchor, strings = (np.array([s[k] for s in held]) for k in ("_anchor", "_strings"))
            own, at, classes = repeated_strings([s["_bytes"] for s in held], anchor, strings, length)
            often = np.flatnonzero(np.bincount(classes, minlength=1)[classes] > 1)
            often = often[np.lexsort([at[often], own[often]])]
            own, at = own[often], at[often]
            fresh = np.ones(len(own), bool)
            fresh[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(fresh)
            out: dict[str, list] = {x: [] for x in names}
            for a, b in zip(first.tolist(), np.append(first[1:], len(own)).tolist()):
                s = held[own[a]]
                if not s["_whole"]:
                    row = [*(s[x] for x in SEGMENT), s["_base"] + int(at[a]), s["_base"] + int(at[b - 1])]
                    for x, v in zip(names, row):
                        out[x].append(v)
            return out

        for batch in batches:
            for row in batch.to_pylist():
                if held and size >= BATCH and (row["_gram"], row["_part"]) != (held[-1]["_gram"], held[-1]["_part"]):
                    yield run()
                    held, size = [], 0
                held.append(row)
                size += len(row["_bytes"])
        if held:
            yield run()

    return common.arrow_map(dealt, search, "_gram bigint, _h1 bigint, _h2 bigint, _from int, _to int")


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """_id, _key (of the text) and _spans, the (from, to) of the starts of repeated strings.

    Documents without any are left out; equal rows have one row.
    """
    gram = min(GRAM, max(1, length // 3))
    rows = _bytes_of(docs, id, text)
    grams = segments_of(rows, length, gram, only_grams=True).groupBy("_gram").agg(F.count("*").alias("_n"))
    grams = scale.stage(grams.where("_n > 1").select("_gram"))
    shared = F.broadcast(grams) if common.small_rows(grams, BROADCAST_GRAMS) else grams
    places = scale.stage(segments_of(rows, length, gram, only_grams=False).join(shared, "_gram", "left_semi"))
    where = F.struct("_id", "_key", "_first", "_strings", "_anchor")
    different = scale.stage(places.groupBy(*SEGMENT).agg(F.count("*").alias("_n"), F.first(where).alias("_w")))
    mixed = different.groupBy("_gram").agg(F.count("*").alias("_of_gram")).where("_of_gram > 1")
    parts = F.ceil(F.col("_of_gram") / GROUP_SEGMENTS).cast("int")
    wanted = different.join(mixed, "_gram").select(*SEGMENT, "_w.*", (F.col("_n") > 1).alias("_whole"), parts.alias("_parts"))
    found = scale.stage(sorted_segments(cut_out(rows, wanted, length, gram), length))
    whole = different.where("_n > 1").select(*SEGMENT, F.lit(0).alias("_from"), (F.col("_w._strings") - 1).alias("_to"))
    runs = whole.union(found)
    spans = places.join(runs, SEGMENT).select(
        "_id", "_key", F.struct((F.col("_first") + F.col("_from")).alias("from"), (F.col("_first") + F.col("_to")).alias("to")).alias("_span")
    )
    return spans.groupBy("_id", "_key").agg(F.collect_set("_span").alias("_spans"))


def _bytes_of(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(
        F.col(id).cast("bigint").alias("_id"), common.text_key(F.col(text)).alias("_key"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_bytes"),
    )


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, keep_bytes: bool = False) -> DataFrame:
    """A row per document: id, n_bytes, n_removed, n_spans, kept_sha256, and the
    kept bytes if asked for."""
    rows = _bytes_of(docs, id, text)
    both = common.join_on(rows, repeated_spans(docs, id, text, length), ["_id", "_key"], "left")
    names = ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_bytes]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            for part in common.sliced(batch, 256):
                out: dict[str, list] = {x: [] for x in names}
                for key, value, spans in zip(part.column("_id").to_pylist(), part.column("_bytes"), part.column("_spans").to_pylist()):
                    data = value.as_py()
                    kept, at, n = [], 0, 0
                    for begin, last in sorted((s["from"], s["to"]) for s in spans or []):
                        if begin > at or not n:
                            kept.append(data[at:begin])
                            n += 1
                        at = max(at, last + length)
                    kept = b"".join([*kept, data[at:]])
                    row = [key, len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept]
                    for x, v in zip(names, row):
                        out[x].append(v)
                yield out

    schema = "_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    made = common.arrow_map(both.select("_id", "_bytes", "_spans"), remove, schema + (", kept binary" if keep_bytes else ""))
    return made.withColumnRenamed("_id", id)
