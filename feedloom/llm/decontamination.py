"""Benchmark decontamination by winnowed fingerprints.

A window is WINDOW consecutive words of an item, or all words of a shorter one.
Of the hashes of its K-word grams a window keeps the least: equal windows keep
equal hashes, so every shared window is among the rows that share a fingerprint,
and a document has about 2 / (WINDOW - K + 2) fingerprints per word. Windows
shorter than K have one gram, themselves.

1. Each document gives its distinct fingerprints; a semi-join keeps those that the
   benchmark has, which go back to the documents.
2. In those documents the hits are extended to all windows with such a
   fingerprint, and their words meet the benchmark's windows in an equi-join.

All of it is Spark's own expressions. The benchmark side is broadcast if it was
counted to be small, else both joins shuffle and the adaptive skew join splits hot
passages. No document meets an item as a pair: an item is a list at its window.

Edge cases: null texts have no words; a document without words is clean, an item
without words is no window. Repeated documents get a row each, repeated items
count once, items without an id mark words but are not counted. An empty
benchmark leaves every document clean. Other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.binding import bind
from feedloom.llm import common
from feedloom.operators import scale

WINDOW = 13
GRAM = 6
# Words are what lies between these, A-Z being lower-cased before.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Windows of the benchmark that may be broadcast: some 200 bytes each.
BROADCAST_WINDOWS = 100_000


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, BETWEEN), "")


def _numbers(n: Column) -> Column:
    """1 to n; none if n is less than 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _with_fingerprints(found: Column, length: int, body: Callable[[Column, Callable], Column]) -> Column:
    """``body(words, least)``: ``least(i)`` is the fingerprint of the window of
    ``length`` words at i."""
    k = min(GRAM, length)

    def of_words(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        grams = bind(hashes, lambda h: F.transform(_numbers(F.size(h) - (k - 1)), lambda i: F.xxhash64(F.slice(h, i, k))))
        return bind(grams, lambda g: body(w, lambda i: F.array_min(F.slice(g, i, length - k + 1))))

    return bind(found, of_words)


def fingerprints(found: Column, length: int) -> Column:
    """Fingerprint of each window of ``length`` words, in order."""
    return _with_fingerprints(
        found, length, lambda w, least: F.transform(_numbers(F.size(w) - (length - 1)), lambda i: least(i))
    )


def windows(found: Column, length: int, wanted: Column | None = None) -> Column:
    """(start, length, words) of each window whose fingerprint is wanted."""

    def body(w: Column, least: Callable) -> Column:
        starts = _numbers(F.size(w) - (length - 1))
        if wanted is not None:
            starts = F.filter(starts, lambda i: F.array_contains(wanted, least(i)))
        return F.transform(
            starts,
            lambda i: F.struct(i.alias("start"), F.lit(length).alias("length"), F.array_join(F.slice(w, i, length), " ").alias("words")),
        )

    return _with_fingerprints(found, length, body)


def benchmark_windows(items: DataFrame, id: str, text: str, window: int) -> DataFrame:
    """``words``, ``length``, ``fingerprint``, ``items`` of each different window."""
    rows = items.select(F.col(id).cast("string").alias("_item"), words(F.col(text)).alias("_words")).where(F.size("_words") > 0)
    sizes = scale.stage(rows.withColumn("_length", F.least(F.size("_words"), F.lit(window))))
    lengths = sorted(r._length for r in sizes.select("_length").distinct().collect())  # at most ``window``
    made = None
    for n in lengths or [window]:
        found = F.arrays_zip(windows(F.col("_words"), n).alias("at"), fingerprints(F.col("_words"), n).alias("print"))
        part = sizes.where(F.col("_length") == n).select("_item", F.explode(found).alias("_w"))
        part = part.select("_item", "_w.at.words", F.lit(n).alias("length"), F.col("_w.print").alias("fingerprint"))
        made = part if made is None else made.unionByName(part)
    return scale.stage(
        made.groupBy("words", "length", "fingerprint").agg(F.collect_set("_item").alias("items"))
    )


def _covered(hits: Column) -> Column:
    """Words in the union of the (start, length) of an array."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(held: Column, hit: Column) -> Column:
        end = hit["start"] + hit["length"]
        return F.struct(
            (held["n"] + F.greatest(F.lit(0), end - F.greatest(held["end"], hit["start"]))).alias("n"),
            F.greatest(held["end"], end).alias("end"),
        )

    return F.aggregate(F.array_sort(hits), start, add, lambda held: held["n"])


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """A row per document: id, _key (of its text), n_words, n_hit (words inside
    windows of the benchmark) and items (ids that have such a window)."""
    bench = benchmark_windows(items, item_id, item_text, window)
    lengths = sorted(r.length for r in bench.select("length").distinct().collect())  # at most ``window``
    small = common.small_rows(bench, BROADCAST_WINDOWS)
    hint = F.broadcast if small else (lambda df: df)
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"), common.text_key(F.col(text)).alias("_key"))

    none = F.array().cast("array<bigint>")
    prints = bind(words(F.col("_text")), lambda w: F.array_distinct(F.concat(none, *[fingerprints(w, n) for n in lengths])))
    shared = (
        rows.select("_id", "_key", F.explode(prints).alias("fingerprint"))
        .join(hint(bench.select("fingerprint").distinct()), "fingerprint", "left_semi")
        .groupBy("_id", "_key")
        .agg(F.collect_set("fingerprint").alias("_wanted"))
    )
    no_windows = F.array().cast("array<struct<start:int,length:int,words:string>>")
    wanted = [windows(F.col("_words"), n, F.col("_wanted")) for n in lengths]
    told = (
        common.join_on(rows, shared, ["_id", "_key"], "left")
        .select("_id", "_key", "_wanted", words(F.col("_text")).alias("_words"))
        .select(
            "_id", "_key", F.size("_words").alias("n_words"),
            F.when(F.col("_wanted").isNotNull(), F.concat(no_windows, *wanted)).alias("_windows"),
        )
    )
    told = scale.stage(told)
    hits = (
        told.dropDuplicates(["_id", "_key"])
        .select("_id", "_key", F.explode("_windows").alias("_w"))
        .select("_id", "_key", "_w.*")
        .join(hint(bench.select("words", "items")), "words")
        .groupBy("_id", "_key")
        .agg(
            F.collect_set(F.struct("start", "length")).alias("_hits"),
            F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        )
        .select("_id", "_key", _covered(F.col("_hits")).alias("n_hit"), "items")
    )
    out = common.join_on(told.drop("_windows"), hits, ["_id", "_key"], "left")
    return out.select(
        F.col("_id").alias(id), "_key", F.col("n_words").cast("bigint").alias("n_words"),
        F.coalesce(F.col("n_hit"), F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def contaminated() -> Column:
    """A twentieth of the words or more are the benchmark's."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
