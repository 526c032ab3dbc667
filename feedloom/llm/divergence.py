"""How far the sources of a language diverge in the words they use.

Chunk factorization. A task numbers the white-space chunks of its documents and cuts
each different chunk into terms once; the terms are joined back to the documents by
the numbers of the chunks. Per language it hands on each different term with the
number of its documents and its occurrences in each source.

A document may hold a term in several chunks; it is counted once, as a task sees all
chunks of a document at once. So documents add up over the tasks, and the result is
that of counting distinct documents of every term.

Then every group of a language, and the language, gives each kept term a share in
parts per thousand million. Term by term, shares are compared to the language's.
Pairs of sources are compared in tiles: a task holds TILE sources times the terms
of one block, and blocks are summed; sources are paired because the pairs are the
result. Terms that neither source has differ by a constant, which is added by count.

White space is that of ASCII, which is in no term, so no term crosses a chunk.

Edge cases: null texts, languages and sources are ''. Every row is a document, repeated
rows too. A chunk of any length is cut as a whole. A (language, source) without terms, and a
language that keeps none, still give their pairs. Other columns are ignored. An
empty table gives nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm import common
from feedloom.operators import scale

# What a term is, and the shares.
# The bytes [A-Za-z\x80-\xFF], of which only A-Z change; others are in no term.
TERM = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 0 for c in range(256)], dtype=np.uint8)
PARTS, ADDED = 1_000_000_000, 5
LEAST_DOCS = 30

# Chunks, repeated ones too, and bytes of text that a task holds before it hands on counts.
HELD_COUNTS, HELD_BYTES = 6_000_000, 32 << 20
# Texts numbered at once; rows handed on at once.
SLICE_BYTES, BATCH_CHUNKS = 2 << 20, 20_000
# Sources and terms compared at once: two tiles of 4 MB.
TILE, BLOCK_TERMS = 64, 8192
BROADCAST_ROWS = 1_000_000
# Counts of one term, by tasks, that may be looked up in one task: some kilobytes each.
HOT_PARTS = 100_000

# A source's number and a count, in one value.
COUNT_BITS = 36
COUNTS = "lang string, term string, docs bigint, counts array<bigint>"


def _read(docs: DataFrame) -> DataFrame:
    empty = F.lit("")
    return docs.select(
        F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"),
        F.coalesce("text", empty).cast("binary").alias("text"),
    )


def sources_of(docs: DataFrame) -> DataFrame:
    """(lang, source, number): the groups, numbered in their language."""
    groups = _read(docs).select("lang", "source").distinct()
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint")
    fits = F.when(number < 1 << (63 - COUNT_BITS), number).otherwise(F.raise_error(F.lit("too many sources in a language")).cast("bigint"))
    return scale.stage(groups.select("lang", "source", fits.alias("number")))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with texts of SLICE_BYTES; a longer text is one more."""
    part = np.cumsum(pc.binary_length(batch.column("text")).to_numpy()) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for at, end in zip(cuts, cuts[1:]):
        yield batch.slice(at, end - at)


def _numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number of chunks of each text, the numbers of these chunks, and the different chunks."""
    chunks = pc.ascii_split_whitespace(texts.cast(pa.binary()).view(pa.string()))
    numbered = chunks.flatten().dictionary_encode()
    return pc.list_value_length(chunks).to_numpy(), numbered.indices.to_numpy(), numbered.dictionary


def _cut(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where the terms of each chunk begin among all, the numbers of these terms, and the different terms."""
    _, ends, data = chunks.buffers()
    ends = np.frombuffer(ends, np.int32)[chunks.offset : chunks.offset + len(chunks) + 1]
    letters = TERM[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data else np.empty(0, dtype=np.uint8)
    ends = ends - ends[0]
    inside = np.append(letters != 0, False)
    # A term begins where none was before or a chunk begins, and ends likewise.
    goes_on = np.append(False, inside[:-1])
    goes_on[ends] = False
    starts = np.flatnonzero(inside & ~goes_on)
    goes_on = inside.copy()
    goes_on[ends] = False
    stops = np.flatnonzero(inside[:-1] & ~goes_on[1:]) + 1
    offsets = np.append(0, np.cumsum(stops - starts)).astype(np.int32)
    terms = [None, pa.py_buffer(offsets), pa.py_buffer(letters[inside[:-1]])]
    terms = pa.Array.from_buffers(pa.binary(), len(starts), terms).dictionary_encode()
    return np.searchsorted(starts, ends), terms.indices.to_numpy(), terms.dictionary


def _occurrences(chunks: np.ndarray, at: np.ndarray, bounds: np.ndarray, terms: np.ndarray, docs: int) -> np.ndarray:
    """Sorted term * docs + document for each occurrence, of chunks in the documents ``at``."""
    terms = terms.astype(np.int64) * docs
    held = np.diff(bounds)
    first = np.where(held > 0, np.append(terms, 0)[bounds[:-1]], -docs)[chunks] + at
    several = np.flatnonzero((held > 1)[chunks])
    chunks, at = chunks[several], at[several]
    others = held[chunks] - 1
    # Those of one chunk stand side by side.
    begin = bounds[chunks] + 1 - (np.cumsum(others) - others)
    rest = terms[np.repeat(begin, others) + np.arange(others.sum())] + np.repeat(at, others)
    found = np.concatenate([first[first >= 0], rest])
    found.sort()
    return found


def _table(held: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    """Terms by language with their documents and their counts by source."""
    langs, sources, sizes, numbers, words = zip(*held)
    # Documents in the order of their groups.
    of_doc = list(zip([x for part in langs for x in part], np.concatenate(sources).tolist()))
    groups = sorted(set(of_doc))
    place = {group: n for n, group in enumerate(groups)}
    group = np.fromiter(map(place.__getitem__, of_doc), np.int64, len(of_doc))
    order = np.argsort(group, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    # Chunks numbered in slices get one number for all.
    different = pa.concat_arrays(words).dictionary_encode()
    begin = np.cumsum([0, *map(len, words)])
    chunks = np.concatenate([different.indices.to_numpy()[n + first] for n, first in zip(numbers, begin)])
    bounds, terms, names = _cut(different.dictionary)
    found = _occurrences(chunks, np.repeat(rank, np.concatenate(sizes)), bounds, terms, len(of_doc))

    def begins(*keys: np.ndarray) -> np.ndarray:
        change = np.ones(len(keys[0]), dtype=bool)
        change[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        return np.flatnonzero(change)

    # Of the same term and document; of these, of the same term and source; of these, of the same term and language.
    pair = begins(found)
    term, doc = np.divmod(found[pair], len(of_doc))
    source = group[order][doc]
    cell = begins(term, source)
    counts = np.diff(np.append(pair[cell], len(found))) | (np.array([n for _, n in groups], dtype=np.int64)[source[cell]] << COUNT_BITS)
    named = sorted({lang for lang, _ in groups})
    lang = np.array([named.index(x) for x, _ in groups], dtype=np.int64)[source[cell]]
    row = begins(term[cell], lang)
    docs = np.diff(np.append(cell[row], len(pair)))
    lists = pa.ListArray.from_arrays(np.append(row, len(cell)).astype(np.int32), pa.array(counts))
    made = [pa.array(named).take(pa.array(lang[row])), names.take(pa.array(term[cell][row])), pa.array(docs), lists]
    return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, target)], schema=target)


def term_counts(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Per task, language and term: documents, and the occurrences in each source
    together with its number."""
    target = common.pa_schema(docs.sparkSession, COUNTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        held: list[tuple] = []
        chunks = size = 0

        def made() -> Iterator[dict[str, list]]:
            for part in common.sliced(_table(held, target), BATCH_CHUNKS):
                yield dict(zip(target.names, part.columns))
            held.clear()

        for batch in batches:
            for part in _slices(batch):
                sizes, numbers, words = _numbered(part.column("text"))
                held.append((part.column("lang").to_pylist(), part.column("number").to_numpy(), sizes, numbers, words))
                chunks, size = chunks + len(sizes) + len(numbers), size + part.column("text").nbytes
                if chunks > HELD_COUNTS or size > HELD_BYTES:
                    yield from made()
                    chunks = size = 0
        if held:
            yield from made()

    few = scale.fits(groups, BROADCAST_ROWS)
    rows = scale.keyed_join(_read(docs), groups, ["lang", "source"], ["text"], small=few)
    return common.arrow_map(rows.select("lang", "number", "text"), count, COUNTS)


def group_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Occurrences of the terms in so many documents of the language, or more, (lang,
    source, term, occurrences), and all (lang, source)."""
    groups = sources_of(docs)
    counts = scale.stage(term_counts(docs, groups))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.count("*").alias("parts"))
    wanted = scale.stage(terms.where(F.col("docs") >= least_docs).drop("docs"))
    counts = counts.drop("docs")
    if scale.fits(wanted, BROADCAST_ROWS):
        found = counts.join(F.broadcast(wanted.drop("parts")), ["lang", "term"])
    elif wanted.where(F.col("parts") > HOT_PARTS).isEmpty():
        found = counts.join(wanted.drop("parts").hint("shuffle_hash"), ["lang", "term"])
    else:
        found = scale.salted_join(counts, wanted.drop("parts"), ["lang", "term"], ["counts"], min_rows=HOT_PARTS)
    each = found.select("lang", "term", F.explode("counts").alias("of"))
    number, count = F.shiftright("of", COUNT_BITS), F.col("of").bitwiseAND((1 << COUNT_BITS) - 1)
    each = each.select("lang", "term", number.alias("number"), count.alias("count"))
    summed = each.groupBy("lang", "number", "term").agg(F.sum("count").alias("occurrences"))
    few = scale.fits(groups, BROADCAST_ROWS)
    named = scale.keyed_join(summed, groups, ["lang", "number"], ["term"], small=few)
    return scale.stage(named.select("lang", "source", "term", "occurrences")), groups.select("lang", "source")


def _share(count: Column) -> Column:
    """Exact for any counts: the product may exceed 64 bits."""
    whole = F.lit(PARTS).cast("decimal(10,0)") * (count + ADDED).cast("decimal(20,0)")
    all_terms = (F.col("n") + ADDED * F.col("v")).cast("decimal(20,0)")
    return F.call_function("div", whole, all_terms).cast("bigint") + 1


def shares(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, v, n, none, p): the groups with the number of kept terms of
    their language, of their occurrences and the share of a term they lack."""
    terms = counts.groupBy("lang").agg(F.count_distinct("term").alias("v"))
    sums = counts.groupBy("lang", "source").agg(F.sum("occurrences").alias("n"))
    zero = F.lit(0).cast("bigint")
    return (
        groups.join(terms, "lang", "left").join(sums, ["lang", "source"], "left")
        .select("lang", "source", F.coalesce("v", zero).alias("v"), F.coalesce("n", zero).alias("n"))
        .withColumn("none", F.when(F.col("v") > 0, _share(zero)))
    )


def _ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= most) if most else ranked


def term_part(counts: DataFrame, told: DataFrame, ranks: int = 50) -> DataFrame:
    """Terms a source has more of than its language, by the difference."""
    of_lang = counts.groupBy("lang", "term").agg(F.sum("occurrences").alias("occurrences"))
    sums = told.groupBy("lang").agg(F.max("v").alias("v"), F.sum("n").alias("n"))
    few = scale.fits(sums)
    q = scale.keyed_join(of_lang, sums, ["lang"], ["term"], small=few)
    q = q.select("lang", "term", _share(F.col("occurrences")).alias("q"))
    p = scale.keyed_join(counts, told, ["lang", "source"], ["term"], small=scale.fits(told, BROADCAST_ROWS))
    p = p.where("occurrences > 0").select("lang", "source", "term", _share(F.col("occurrences")).alias("p"))
    few = scale.fits(q, BROADCAST_ROWS)
    both = scale.keyed_join(p, q, ["lang", "term"], ["source"], small=few).where("p > q")
    rows = both.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return _ranked(rows, ranks).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def _tile_pair(ours: dict[str, list], theirs: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of differences of two tiles over the terms that either source has, and their number."""
    place: dict[str, int] = {}
    for terms in [*ours["terms"], *theirs["terms"]]:
        for t in terms:
            place.setdefault(t, len(place))
    tables = []
    for tile in (ours, theirs):
        p = np.repeat(np.array(tile["none"], dtype=np.int64)[:, None], len(place), axis=1)
        has = np.zeros(p.shape, dtype=bool)
        for n, terms in enumerate(tile["terms"]):
            at = [place[t] for t in terms]
            p[n, at], has[n, at] = tile["p"][n], True
        tables.append((p, has))
    (a, has_a), (b, has_b) = tables
    sums, either = np.empty((2, len(a), len(b)), dtype=np.int64)
    for n in range(len(a)):
        some = has_b | has_a[n]
        sums[n] = np.where(some, np.abs(b - a[n]), 0).sum(axis=1)
        either[n] = some.sum(axis=1)
    return sums, either


def pair_part(counts: DataFrame, told: DataFrame) -> DataFrame:
    """Each other source of the language, by the sum of differences over the kept terms."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK_TERMS)).cast("int")
    sources = told.groupBy("lang").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    sources = told.join(sources, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), "tiles"))
    sources = scale.stage(sources.select("lang", "source", "v", "n", F.coalesce("none", F.lit(0)).alias("none"), "tile"))
    here = scale.keyed_join(counts, sources, ["lang", "source"], ["term"], small=scale.fits(sources, BROADCAST_ROWS))
    held = ["lang", "tile", "source", "v", "none", "block"]
    has = F.struct("term", _share(F.col("occurrences")).alias("p"))
    p = here.withColumn("block", F.pmod(F.xxhash64("term"), blocks).cast("int")).select(*held, has.alias("has"))
    # Every source is in every block, if with no term.
    every = sources.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    every = every.select(*held, F.lit(None).cast(p.schema["has"].dataType).alias("has"))
    # A source has about BLOCK_TERMS terms in a block, a tile about TILE sources.
    vectors = p.unionByName(every).groupBy(*held).agg(F.collect_list("has").alias("has"))
    row = F.struct("source", "none", F.col("has.term").alias("terms"), F.col("has.p").alias("p"))
    tiles = scale.stage(vectors.groupBy("lang", "v", "block", "tile").agg(F.collect_list(row).alias("rows")))
    others = tiles.select("lang", "block", F.col("tile").alias("other"), F.col("rows").alias("others"))
    met = tiles.join(others, ["lang", "block"]).where("tile <= other").select("lang", "v", "tile", "other", "rows", "others")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            for part in common.sliced(batch, 1):
                lang, v, tile, other, rows, others = (c.to_pylist()[0] for c in part.columns)
                ours, theirs = ({k: [r[k] for r in x] for k in ("source", "none", "terms", "p")} for x in (rows, others))
                sums, either = _tile_pair(ours, theirs)
                out = [
                    (lang, v, min(a, b), max(a, b), abs(ours["none"][i] - theirs["none"][j]), int(sums[i, j]), int(either[i, j]))
                    for i, a in enumerate(ours["source"]) for j, b in enumerate(theirs["source"])
                    if tile < other or i < j
                ]
                if out:
                    yield dict(zip(("lang", "v", "a", "b", "apart", "sum", "either"), map(list, zip(*out))))

    schema = "lang string, v bigint, a string, b string, apart bigint, sum bigint, either bigint"
    pairs = common.arrow_map(met, compare, schema).groupBy("lang", "v", "a", "b", "apart")
    # Terms that neither has add the same difference each.
    value = F.sum("sum") + (F.col("v") - F.sum("either")) * F.col("apart")
    way = lambda x, y: F.struct(F.col(x).alias("source"), F.col(y).alias("item"))
    ways = F.array(way("a", "b"), way("b", "a"))
    rows = pairs.agg(value.alias("value")).select("lang", F.explode(ways).alias("x"), "value")
    return _ranked(rows.select("lang", "x.source", "x.item", "value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: pairs of sources, and the terms of each."""
    counts, groups = group_terms(docs, least_docs)
    told = scale.stage(shares(counts, groups))
    return pair_part(counts, told).unionByName(term_part(counts, told, ranks))
