import re
from collections import Counter, defaultdict

import oracle
import pyarrow as pa
import pytest

from feedloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, ids int"


def plainly(docs, least):
    """All parts from the definition."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held, used = defaultdict(set), defaultdict(Counter)
    for no, (_, text, lang, source) in enumerate(docs):
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        used[lang, source].update(terms)
        for t in terms:
            held[lang, t].add(no)
    kept = defaultdict(list)
    for (lang, t), nos in held.items():
        if len(nos) >= least:
            kept[lang].append(t)
    share = lambda c, n, v: 1 + 10**9 * (c + 5) // (n + 5 * v)
    out = []
    for lang in {k[0] for k in used}:
        terms, sources = kept[lang], {s: used[k] for k in used if k[0] == lang for s in [k[1]]}
        v = len(terms)
        whole = sum(sources.values(), Counter())
        n_all = sum(whole[t] for t in terms)
        p = {}
        for s, c in sources.items():
            n = sum(c[t] for t in terms)
            p[s] = {t: share(c[t], n, v) for t in terms}
        for s, c in sources.items():
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in terms), o.encode(), o) for o in sources if o != s]
            own = [(share(whole[t], n_all, v) - p[s][t], t.encode(), t) for t in terms if c[t] and p[s][t] > share(whole[t], n_all, v)]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(own)[:50])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(rows, 1)]
    return sorted(out)


def docs_of(n):
    words = ["The", "the,", "tHe.", "foo-foo", "foo", "Foo(", "naïve", "NAÏVE", "a b", "x1y", "日本", " é", "__", "12", "z" * 300]
    out = []
    for i in range(n):
        some = [words[(i * k * k + k) % len(words)] for k in range(1, 2 + i % 9)]
        out.append((i % 7, " \n\t".join(some), ["en", "de", None, ""][i % 4], [f"s{i % 5}", None, "ä", "Z"][i % 3]))
    return out


CASES = [
    (docs_of(300), 30),
    (docs_of(40) * 3, 12),  # repeated rows are documents of their own
    ([(1, None, None, None), (2, "", "en", "a"), (3, "!!", "en", "b"), (4, "w " * 200_000, "en", "c")], 30),  # no kept term
    ([(n, "Same word. same" if n % 2 else "SAME(", "en", f"s{n % 2}") for n in range(30)], 30),  # only distinct documents tell
    ([(n, "Same word. same" if n % 2 else "SAME(", "en", f"s{n % 2}") for n in range(29)], 30),
    ([(1, "lonely", "en", "a")] * 40, 30),  # one source has no pair
]


@pytest.mark.parametrize("docs,least", CASES)
@pytest.mark.parametrize("small", [False, True, "hot"])
def test_like_the_definition(spark, monkeypatch, docs, least, small):
    if small:
        for name, value in (("TILE", 1), ("BLOCK_TERMS", 2), ("HELD_COUNTS", 3), ("BATCH_CHUNKS", 2), ("BROADCAST_ROWS", 0)):
            monkeypatch.setattr(divergence, name, value)
    if small == "hot":
        monkeypatch.setattr(divergence, "HOT_PARTS", 1)
    rows = spark.createDataFrame([(*d, "own", 1) for d in docs], SCHEMA)
    got = divergence.audit(rows, least).collect()
    assert sorted(tuple(r) for r in got) == plainly(docs, least)


def test_counts_beyond_64_bits(spark):
    """A share of a term seen ten thousand million times."""
    rows = spark.createDataFrame([("en", "a", "t", 3 * 10**13), ("en", "a", "u", 7)], "lang string, source string, term string, occurrences long")
    told = divergence.shares(rows, rows.select("lang", "source").distinct()).first()
    assert (told.v, told.n, told.none) == (2, 3 * 10**13 + 7, 1 + 5 * 10**9 // (3 * 10**13 + 17))
    got = divergence.term_part(rows.withColumn("source", divergence.F.lit("b")).unionByName(rows), divergence.shares(rows, rows.select("lang", "source").distinct()))
    assert got.count() == 0  # both have the language's shares


def test_spellings_of_a_term_leave_a_task_as_one(spark, monkeypatch):
    """No table is as long as the different chunks, nor is a term counted twice in a document."""
    docs = [(n, f"word{'!' * n} ({n})WORD/word wOrd_{n}", "en", f"s{n % 2}") for n in range(90)]
    rows = spark.createDataFrame([(*d, "own", 1) for d in docs], SCHEMA).coalesce(2)
    stage, staged = divergence.scale.stage, []
    monkeypatch.setattr(divergence.scale, "stage", lambda df: staged.append(stage(df)) or staged[-1])
    for least in (90, 91):
        got = divergence.audit(rows, least).collect()
        assert sorted(tuple(r) for r in got) == plainly(docs, least)
    assert max(df.count() for df in staged) <= 4


def test_slices_are_counted_together(monkeypatch):
    """Chunks of more and of no terms, texts without any, and terms at both ends of chunks and slices."""
    texts = ["", " \n", "!! -- 1", "Ab-ab\x0bab éx", "ab", "É é x" * 3, None, "a" * 50 + "-b", "b-" + "a" * 50, "ab,AB ab", "日本-ab 本"] * 3
    rows = [(["en", "de", ""][n % 3], n % 2 + 1, (t or "").encode()) for n, t in enumerate(texts)]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.large_binary()))]
    batch = pa.RecordBatch.from_arrays(columns, names=["lang", "number", "text"])
    fields = (("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("counts", pa.list_(pa.int64())))
    held, used = Counter(), defaultdict(Counter)
    for lang, number, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text.decode()))
        held.update({(lang, t) for t in terms})
        for t in terms:
            used[lang, t][number] += 1
    for size in (1, 20, 1 << 20):
        monkeypatch.setattr(divergence, "SLICE_BYTES", size)
        parts = [(x, *divergence._numbered(x.column("text"))) for x in divergence._slices(batch)]
        assert sum(x.num_rows for x, *_ in parts) == len(rows) and (len(parts) > 1) == (size < 1 << 20)
        table = divergence._table([(x.column("lang").to_pylist(), x.column("number").to_numpy(), *n) for x, *n in parts], pa.schema(fields))
        got = table.to_pylist()
        bits = divergence.COUNT_BITS
        assert {(r["lang"], r["term"]): r["docs"] for r in got} == held and len(got) == len(held)
        assert {(r["lang"], r["term"]): {x >> bits: x & (1 << bits) - 1 for x in r["counts"]} for r in got} == used
    empty = divergence._numbered(batch.slice(0, 0).column("text"))
    assert divergence._table([([], batch.slice(0, 0).column("number").to_numpy(), *empty)], pa.schema(fields)).num_rows == 0


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_as_in_sql(spark):
    oracle.assert_equal(spark, "op12_source_divergence", "/root/testdata/sf0.01")
