"""Near-duplicate documents by order MinHash, verified by banded alignment.

The shingles of a text are its runs of SHINGLE words (a shorter text is one
shingle), each labelled with its occurrence number. A sketch takes the PICKED
labelled shingles of least hash and keeps them in text order; there are SKETCHES
of them, of different hashes. Two texts are candidates if any sketch agrees. Of a
pair whose shorter text has at most FEW shingles none is left to chance: similar
texts share one of the first labelled shingles of each, the rarest first, as many as
may be unmatched and one more; these are buckets too. Candidates are linked if aligning their shingle sequences matches a share of at least
SIMILARITY: matched / (all of both - matched), the Jaccard similarity of sequences.
At that share at most 1/9 of all shingles are unmatched, which bounds the band of
the alignment.

Copies (equal words) are one text from the start. Of each bucket of equal sketches
the members are first compared with one leader: the text that shares most buckets
with most others, as the original of near copies does. Then components are found.
Where members of one bucket are still in different components, the texts of its
leader are compared in tiles inside the tasks: those outside the leader's component
with each other and with those inside. Shared labelled shingles are counted for a
tile at once; only pairs that share enough for the similarity, and are not joined
already, are aligned. Only links leave the task, no pairs. So every candidate pair
is aligned, joined, or ruled out by its sizes or its number of shared shingles, and
a bucket of n near copies costs n comparisons.

Edge cases: words are runs of letters, digits and underscores, lower-cased. Texts
without words (null, empty) are linked to nothing. Repeated rows are copies; a
class without any id has a null id. An empty table gives no rows. Very long texts
are whole; their alignment takes time with their length and their differences.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm import common
from feedloom.operators import scale

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 24
PICKED = 4
# Shingles up to which a text finds all its near copies.
FEW = 32
CACHE_WORDS = 500_000
# Matches per element up to which an alignment walks all of them.
MOST_MATCHES = 20
# Texts, and shingles of all of them, that a tile holds; marks compared at once.
TILE, TILE_SHINGLES, TILE_MARKS = 512, 2_000_000, 4096
_WORD = re.compile(r"\w+")
_MULTIPLIERS = np.random.default_rng(97).integers(1, 1 << 63, SKETCHES, dtype=np.uint64) | np.uint64(1)
_SIGNED = np.uint64(1 << 63)


class Shingles:
    """Texts to sequences of shingle hashes; remembers the hashes of words."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def words(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def __call__(self, words: np.ndarray) -> np.ndarray:
        n = max(1, len(words) - SHINGLE + 1) if len(words) else 0
        out = np.zeros(n, np.uint64)
        for k in range(min(SHINGLE, len(words))):
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
        return _mixed(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Hashes of (shingle, its occurrence number in the text)."""
    order = np.argsort(shingles, kind="stable")
    held = shingles[order]
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    number = np.arange(len(held)) - np.repeat(first, np.diff(np.append(first, len(held))))
    if not number.any():
        return shingles
    out = shingles.copy()
    out[order] = _mixed(held + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def sketches(shingles: np.ndarray) -> list[int]:
    """One signed 64-bit bucket per sketch; sketches of different numbers differ."""
    marks, out = labelled(shingles), []
    for number, multiplier in enumerate(_MULTIPLIERS):
        hashes = marks * multiplier
        hashes ^= hashes >> np.uint64(32)
        least = np.argpartition(hashes, PICKED - 1)[:PICKED] if len(hashes) > PICKED else np.arange(len(hashes))
        kept = marks[np.sort(least)]
        out.append(xxhash.xxh64_intdigest(kept.tobytes(), seed=number) - (1 << 63))
    return out


def missed(n: int, m: int, shared: int) -> float:
    """Probability that texts of n and m shingles, more than FEW, share no sketch."""
    agree = np.prod([(shared - i) / (n + m - shared - i) for i in range(PICKED)])
    return float((1 - agree) ** SKETCHES)


def matched(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Similarity of two sequences if it is at least ``least``, else 0.

    ``least`` bounds how many elements stay unmatched, and so how far from the
    diagonal a match can be. Matches in that band are walked in order of ``a``; the
    longest rising run of their places in ``b`` is the alignment. Sequences that
    repeat themselves have too many matches for that and go along the diagonals.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    # matched = (n + m - d) / 2, so matched / (n + m - matched) >= least bounds d.
    most = int((n + m) * (1 - least) / (1 + least) + 1e-9)
    if abs(n - m) > most:
        return 0.0
    order = np.argsort(b, kind="stable")
    held = b[order]
    low, high = np.searchsorted(held, a, "left"), np.searchsorted(held, a, "right")
    times = high - low
    if n + m - 2 * int((times > 0).sum()) > most:
        return 0.0
    total = int(times.sum())
    if total > MOST_MATCHES * (n + m):
        unmatched = _along_diagonals(a, b, most)
    else:
        at = np.repeat(np.arange(n), times)
        # Of one element of a, the later places in b come first: only one can be taken.
        place = order[np.repeat(high, times) - 1 - (np.arange(total) - np.repeat(np.cumsum(times) - times, times))]
        place = place[np.abs(at - place) <= most]
        ends: list[int] = []
        for x in place.tolist():
            k = bisect_left(ends, x)
            if k == len(ends):
                ends.append(x)
            else:
                ends[k] = x
        unmatched = n + m - 2 * len(ends)
    if unmatched is None or unmatched > most:
        return 0.0
    common_part = (n + m - unmatched) / 2
    return common_part / (n + m - common_part)


def _along_diagonals(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Unmatched elements of the best alignment, if at most ``most``: the furthest
    reach on each diagonal of the band after 0, 1, ... of them."""
    n, m = len(a), len(b)

    def slide(x: int, y: int) -> int:
        """How far both go on equally."""
        begun, step = x, 32
        while x < n and y < m:
            part = min(step, n - x, m - y)
            differ = np.flatnonzero(a[x : x + part] != b[y : y + part])
            if len(differ):
                return x + int(differ[0]) - begun
            x, y, step = x + part, y + part, step * 4
        return x - begun

    reach = {1: 0}
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            if x <= n and x - k <= m:
                x += slide(x, x - k)
            reach[k] = x
            if x == n and x - k == m:
                return d
    return None


def sketched(docs: DataFrame, id: str, text: str, few: int) -> DataFrame:
    """_id, _key (of the text), _words (of its words, null if none), n, sketches,
    marks (labelled shingles, of texts with at most ``few``)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        shingles = Shingles()
        for batch in batches:
            for part in common.sliced(batch):
                names, sizes, found, marks = [], [], [], []
                for value in part.column("_text"):
                    words = shingles.words(value.as_py() or "")
                    names.append(xxhash.xxh128_digest(words.tobytes()) if len(words) else None)
                    own = shingles(words)
                    sizes.append(len(own))
                    found.append(sketches(own) if len(own) else None)
                    marks.append(labelled(own).view(np.int64) if 0 < len(own) <= few else None)
                yield {
                    "_id": part.column("_id"), "_key": part.column("_key"),
                    "_words": names, "n": sizes, "sketches": found, "marks": marks,
                }

    rows = docs.select(F.col(id).cast("bigint").alias("_id"), F.col(text).alias("_text"), common.text_key(F.col(text)).alias("_key"))
    return common.arrow_map(rows, sketch, "_id bigint, _key bigint, _words binary, n int, sketches array<bigint>, marks array<bigint>")


def first_marks(different: DataFrame, similarity: float) -> DataFrame:
    """(_node, _bucket): the rarest labelled shingles of each text that has marks.

    Of n shingles at most n - similarity * n stay unmatched, so of similar texts,
    both in the order of rarity, the first ones by one more than that have one in
    common: the first of all that both share.
    """
    own = different.where("marks IS NOT NULL").select("_node", "n", F.explode("marks").alias("_mark"))
    times = own.groupBy("_mark").agg(F.count("*").alias("_n")).where("_n > 1")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("_n", F.lit(1)).alias("_n"), "_mark")))
    size = (F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).cast("int")
    ordered = own.join(times, "_mark", "left").groupBy("_node", "n").agg(order.alias("_marks"))
    kept = ordered.select("_node", F.explode(F.slice("_marks", F.lit(1), F.least(size, "n"))).alias("_first"))
    return kept.where("_first._n > 1").select("_node", F.xxhash64(F.lit("mark"), "_first._mark").alias("_bucket"))


def sequences(texts: DataFrame) -> DataFrame:
    """(_node, _seq) of (_node, _text): the shingles as 64-bit numbers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        shingles = Shingles()
        for batch in batches:
            for part in common.sliced(batch):
                told = [shingles(shingles.words(x.as_py())).tobytes() for x in part.column("_text")]
                yield {"_node": part.column("_node"), "_seq": told}

    return common.arrow_map(texts.select("_node", "_text"), cut, "_node bigint, _seq binary")


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    return matched(a, b, similarity) >= similarity - 1e-12


def verified(pairs: DataFrame, told: DataFrame, similarity: float) -> DataFrame:
    """The pairs (_a, _b) of numbered texts that are similar enough."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            for part in common.sliced(batch, 256):
                out: dict[str, list] = {"_a": [], "_b": []}
                for a, b, x, y in zip(*[part.column(c).to_pylist() for c in ("_a", "_b", "_seq_a", "_seq_b")]):
                    if _similar(np.frombuffer(y, np.uint64), np.frombuffer(x, np.uint64), similarity):
                        out["_a"].append(a)
                        out["_b"].append(b)
                yield out

    first = told.select(F.col("_node").alias("_a"), F.col("_seq").alias("_seq_a"))
    second = told.select(F.col("_node").alias("_b"), F.col("_seq").alias("_seq_b"))
    both = pairs.join(first, "_a").join(second, "_b").select("_a", "_b", "_seq_a", "_seq_b")
    return common.arrow_map(both, align, "_a bigint, _b bigint")


def shared_marks(ours: list[np.ndarray], theirs: list[np.ndarray]) -> np.ndarray:
    """How many labelled shingles each of ours shares with each of theirs."""
    out = np.zeros((len(ours), len(theirs)), np.float32)
    both = np.intersect1d(np.concatenate(ours), np.concatenate(theirs))
    placed = []
    for side in (ours, theirs):
        marks = np.concatenate(side)
        at = np.searchsorted(both, marks)
        held = (at < len(both)) & (both[np.minimum(at, len(both) - 1)] == marks) if len(both) else np.zeros(len(marks), bool)
        placed.append((np.repeat(np.arange(len(side)), [len(x) for x in side])[held], at[held]))
    for begin in range(0, len(both), TILE_MARKS):
        tables = []
        for side, (row, at) in zip((ours, theirs), placed):
            here = (at >= begin) & (at < begin + TILE_MARKS)
            table = np.zeros((len(side), min(TILE_MARKS, len(both) - begin)), np.float32)
            table[row[here], at[here] - begin] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out.astype(np.int64)


def tile_links(ours: list[tuple], theirs: list[tuple], same: bool, similarity: float) -> list[tuple[int, int]]:
    """Links that join components, of texts (_node, _root, sequence) of two tiles."""
    marks = [[labelled(x[2]) for x in side] for side in (ours, theirs)]
    n, m = (np.array([len(x) for x in side]) for side in marks)
    both = n[:, None] + m[None, :]
    most = (both * (1 - similarity) / (1 + similarity) + 1e-9).astype(np.int64)
    apart = both - 2 * shared_marks(*marks)
    roots = [np.array([x[1] for x in side]) for side in (ours, theirs)]
    close = (apart <= most) & (roots[0][:, None] != roots[1][None, :])
    if same:
        close = np.triu(close, 1)
    i, j = np.nonzero(close)
    order = np.argsort(apart[i, j], kind="stable")
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while x in parent:
            x = parent[x]
        return x

    out = []
    for k in order.tolist():
        a, b = ours[i[k]], theirs[j[k]]
        x, y = top(a[1]), top(b[1])
        if x != y and _similar(a[2], b[2], similarity):
            parent[max(x, y)] = min(x, y)
            out.append((a[0], b[0]))
    return out


def links_in_tiles(groups: DataFrame, told: DataFrame, similarity: float) -> DataFrame:
    """Links (_a, _b) between components within groups (_lead, _node, _root, n) of
    texts: all pairs are compared but those of which both are in the leader's."""
    lead = groups.where("_node = _lead").select("_lead", F.col("_root").alias("_inside"))
    rows = groups.join(lead, "_lead").withColumn("_out", F.col("_root") != F.col("_inside"))

    def tiles(which: Column) -> Column:
        rows, shingles = F.count(F.when(which, 1)), F.sum(F.when(which, F.col("n")))
        return F.coalesce(F.greatest(F.ceil(rows / TILE), F.ceil(shingles / TILE_SHINGLES)), F.lit(0))

    counted = rows.groupBy("_lead").agg(tiles(~F.col("_out")).alias("_ins"), tiles(F.col("_out")).alias("_outs"))
    rows = rows.join(counted.where("_outs > 0"), "_lead")
    tile = F.when(F.col("_out"), F.col("_ins") + F.pmod(F.xxhash64("_node"), F.greatest("_outs", F.lit(1))))
    tile = tile.otherwise(F.pmod(F.xxhash64("_node"), F.greatest("_ins", F.lit(1))))
    first = F.when(F.col("_out"), F.lit(0)).otherwise(F.col("_ins"))
    rows = rows.withColumn("_tile", tile).withColumn("_other", F.explode(F.sequence(first, F.col("_ins") + F.col("_outs") - 1)))
    rows = rows.withColumns({"_p": F.least("_tile", "_other"), "_q": F.greatest("_tile", "_other")})
    rows = rows.select("_lead", "_p", "_q", "_tile", "_node", "_root").join(told, "_node")
    keys = ["_lead", "_p", "_q"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "_tile", "_node")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        key, sides = None, ([], [])

        def done() -> dict[str, list]:
            same = key[1] == key[2]
            ours, theirs = (sides[0], sides[0]) if same else sides
            found = tile_links(ours, theirs, same, similarity) if ours and theirs else []
            return {"_a": [a for a, _ in found], "_b": [b for _, b in found]}

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, "_tile", "_node", "_root", "_seq")]
            for lead, p, q, tile, node, root, seq in zip(*columns):
                if key != (lead, p, q):
                    if key:
                        yield done()
                    key, sides = (lead, p, q), ([], [])
                sides[tile != p].append((node, root, np.frombuffer(seq, np.uint64)))
        if key:
            yield done()

    return common.arrow_map(dealt, link, "_a bigint, _b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(_node, _root): the least member of the component of each linked text.

    Large-star and small-star steps in turn until nothing changes: a node links
    its larger neighbours, then its smaller ones, to the least it knows. Edges are
    written to the shared folder after each turn; no list of neighbours is built.
    """
    edges = scale.stage(edges.select(F.greatest("_a", "_b").alias("_u"), F.least("_a", "_b").alias("_v")).distinct())
    while True:
        both = edges.union(edges.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        least = both.groupBy("_u").agg(F.least(F.min("_v"), F.col("_u")).alias("_m"))
        large = both.where("_v > _u").join(least, "_u").select(F.col("_v").alias("_u"), F.col("_m").alias("_v")).distinct()
        large = scale.stage(large.where("_u <> _v"))
        least = large.groupBy("_u").agg(F.min("_v").alias("_m"))
        small = (
            large.join(least, "_u")
            .select(F.col("_v").alias("_u"), F.col("_m").alias("_v"))
            .union(least.select("_u", F.col("_m").alias("_v")))
            .where("_u <> _v")
            .distinct()
        )
        new = scale.stage(small)
        if new.count() == edges.count() and new.exceptAll(edges).isEmpty():
            return new.select(F.col("_u").alias("_node"), F.col("_v").alias("_root"))
        edges = new


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row per document: id, _key (of its text), class_id (least id of its
    class), _first (whether it is the one of its class that stays)."""
    rows = scale.stage(sketched(docs, id, text, int(FEW / similarity + 1e-9)))
    different = rows.where("_words IS NOT NULL").groupBy("_words").agg(
        F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_key")).alias("_at"),
        F.first("n").alias("n"), F.first("sketches").alias("sketches"), F.first("marks").alias("marks"),
    )
    # Each different text gets a number, fixed by writing it.
    different = scale.stage(
        different.select(F.monotonically_increasing_id().alias("_node"), "_words", "_at._id", "_at._key", "n", "sketches", "marks")
    )
    members = different.select("_node", F.explode("sketches").alias("_bucket")).union(first_marks(different, similarity))
    sizes = members.groupBy("_bucket").agg(F.count("*").alias("_size")).where("_size > 1")
    shared = scale.stage(members.join(sizes, "_bucket"))
    # The text in most company leads, so the buckets of near copies tend to agree on it.
    company = shared.groupBy("_node").agg(F.sum("_size").alias("_met"))
    lead = F.max(F.struct("_met", (-F.col("_node")).alias("_node")))["_node"]
    leaders = shared.join(company, "_node").groupBy("_bucket").agg((-lead).alias("_lead"))
    shared = scale.stage(shared.join(leaders, "_bucket"))

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs that their sizes do not rule out."""
        a, b = (different.select(F.col("_node").alias(x), F.col("n").alias("n" + x)) for x in ("_a", "_b"))
        sizes = F.least("n_a", "n_b") >= F.lit(similarity) * F.greatest("n_a", "n_b") - 1e-9
        return scale.stage(pairs.join(a, "_a").join(b, "_b").where(sizes).select("_a", "_b"))

    starred = likely(shared.where("_node <> _lead").select(F.col("_node").alias("_a"), F.col("_lead").alias("_b")).distinct())
    starred = starred.select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b")).distinct()

    whole = docs.select(F.col(id).cast("bigint").alias("_id"), F.col(text).alias("_text"), common.text_key(F.col(text)).alias("_key"))
    wanted = shared.select("_node").distinct().join(different, "_node").select("_node", "_id", "_key")
    texts = common.join_on(whole, wanted, ["_id", "_key"], "inner")
    told = scale.stage(sequences(texts.dropDuplicates(["_node"])))

    links = scale.stage(verified(starred, told, similarity))
    roots = components(links)
    # What is left: buckets with texts of different components.
    placed = shared.join(roots, "_node", "left").withColumn("_root", F.coalesce("_root", "_node")).where("_size > 2")
    placed = scale.stage(placed.join(different.select("_node", "n"), "_node"))
    mixed = placed.groupBy("_bucket").agg(F.min("_root").alias("_low"), F.max("_root").alias("_high")).where("_low <> _high")
    groups = placed.join(mixed.select("_bucket"), "_bucket", "left_semi").select("_lead", "_node", "_root", "n").distinct()
    more = links_in_tiles(scale.stage(groups), told, similarity)
    roots = components(links.union(more))

    named = different.select("_node", "_words").join(roots, "_node", "left").select("_words", F.coalesce("_root", "_node").alias("_class"))
    alone = F.xxhash64(F.col("_id").isNull(), "_id", "_key")
    named = rows.select("_id", "_key", "_words").join(named, "_words", "left")
    named = named.select("_id", "_key", F.coalesce("_class", alone).alias("_class"), F.col("_class").isNull().alias("_alone"))
    named = scale.stage(named)
    by = ["_alone", "_class"]
    best = named.groupBy(*by).agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_key")).alias("_at"))
    out = named.join(best, by)
    first = F.col("_id").eqNullSafe(F.col("_at._id")) & F.col("_key").eqNullSafe(F.col("_at._key"))
    return out.select(F.col("_id").alias(id), "_key", F.col("_at._id").alias("class_id"), first.alias("_first"))
