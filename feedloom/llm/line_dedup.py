"""Lines that were seen before, exactly or with one word edited.

A line is its words between white space. It goes if an earlier line (by document
id, then line number) has the same words or, both having at least FUZZY_WORDS, is
one word inserted, deleted or replaced away. Blank lines stay.

1. Equal lines are found by 128 bits of hash, combined map-side.
2. One edit leaves the first or the last words of a line alone. Only lines that
   share such an end with a different line go on; the ends grow with the line.
3. Each of these gives its deletion neighbourhood, the line and the line without
   each word, as hashed keys. Equal keys join: of lines without the same word
   place the earliest is within one replacement of all others; a line and those
   that become it are within one deletion.
4. The edit distance is verified on the words, and the later line goes.
5. The numbers of lines that go return to their documents.

All of it is Spark's own expressions. A neighbourhood of n words is hashed with
n ^ 1.5 steps. Lists are only built per line and per document; hot lines, ends and
keys are reduced map-side, and where their rows meet them again the adaptive skew
join splits them. Sides are broadcast after they were counted to be small.

Edge cases: a null text stays null and has no lines. Documents equal in id and text are one
document and get equal results; null ids come last. An empty table gives no rows.
Other columns are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.binding import bind
from feedloom.llm import common
from feedloom.operators import scale

# White space inside a line, besides the blank.
OTHER_SPACE = "\t\r\f\v"
FUZZY_WORDS = 10
# Words at either end that must agree, and the lengths of line they are used for.
# Each is at most half of its shortest line; ranges overlap by one length, as one
# edit changes the length by one.
ENDS = ((5, 10, 20), (10, 20, 40), (20, 40, 100), (50, 100, 1 << 30))
# Rows of up to 80 bytes that may be broadcast.
BROADCAST_KEYS = 1_000_000
LINE = ["_h1", "_h2"]


def _lines_of(text: Column) -> Column:
    """The lines of a text, blanks its only white space."""
    odd = [F.contains(text, F.lit(x)) for x in OTHER_SPACE]
    plain = F.when(reduce(Column.__or__, odd), F.translate(text, OTHER_SPACE, " " * len(OTHER_SPACE))).otherwise(text)
    return F.split(plain, "\n")


def _words_of(line: Column) -> Column:
    # Splitting at one character is much faster than at a pattern.
    return F.array_remove(F.split(line, " "), "")


def lines(docs: DataFrame) -> DataFrame:
    """_id, _key, _line (number), _words, _h1, _h2 of the lines that are not blank."""
    split = F.transform(_lines_of(F.col("_text")), _words_of)
    rows = docs.select("_id", "_key", F.posexplode(split).alias("_line", "_words")).where(F.size("_words") > 0)
    return rows.withColumns({"_h1": F.xxhash64("_words"), "_h2": F.xxhash64(F.lit(1), "_words")})


def place() -> Column:
    """Where a line stands in the order of all lines."""
    return F.struct(F.col("_id").isNull().alias("none"), "_id", "_key", "_line")


def ends(words: Column) -> Column:
    """Hashes of the first and last words that a line of this length may share."""
    n, none = F.size(words), F.array().cast("array<bigint>")
    found = [
        F.when(
            n.between(least, most),
            F.array(
                F.xxhash64(F.lit(size), F.slice(words, 1, size)),
                F.xxhash64(F.lit(-size), F.slice(words, n - (size - 1), size)),
            ),
        ).otherwise(none)
        for size, least, most in ENDS
    ]
    return F.concat(*found)


def neighbourhood(words: Column) -> Column:
    """(key, at): the line's own key at 0 and the key without its at-th word.

    A key is the exclusive or of hashed (word, place); without a word the places
    behind it move up. Two-level partial results keep prefixes cheap.
    """

    def xor(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda held, x: held.bitwiseXOR(x))

    def of(stay: Column, moved: Column) -> Column:
        """Keys from the hashes of words in place and moved up by one."""
        both = F.zip_with(stay, moved, lambda x, y: x.bitwiseXOR(y))
        step = F.ceil(F.sqrt(F.size(stay))).cast("int")

        def keys(change: Column, behind: Column, step: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.size(change) - 1, step), lambda b: xor(F.slice(change, b + 1, step)))

            def key(i: Column, blocks: Column) -> Column:
                whole = (i / step).cast("int")
                before = xor(F.slice(blocks, 1, whole)).bitwiseXOR(xor(F.slice(change, whole * step + 1, i - whole * step)))
                return behind.bitwiseXOR(before).bitwiseXOR(F.get(moved, i))

            return bind(
                blocks,
                lambda bs: F.transform(
                    F.sequence(F.lit(0), F.size(change) - 1),
                    lambda i: F.struct(key(i, bs).alias("key"), (i + 1).alias("at")),
                ),
            )

        inner = bind(both, lambda c: bind(xor(moved), lambda m: bind(step, lambda s: keys(c, m, s))))
        return F.concat(F.array(F.struct(xor(stay).alias("key"), F.lit(0).alias("at"))), inner)

    hashed = F.transform(words, lambda x, i: F.xxhash64(x, i))
    return bind(hashed, lambda s: bind(F.transform(words, lambda x, i: F.xxhash64(x, i - 1)), lambda m: of(s, m)))


def one_edit(a: Column, b: Column) -> Column:
    """Whether two lines are at most one word apart, by their words."""

    def shorter(longer: Column, other: Column) -> Column:
        # The first word at which they part is the one too many.
        n = F.size(other)
        parts = F.array_position(F.zip_with(F.slice(longer, 1, n), other, lambda x, y: x != y), True).cast("int")
        at = F.when(parts == 0, n + 1).otherwise(parts)
        return F.slice(longer, at + 1, n + 1) == F.slice(other, at, n + 1)

    replaced = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x)) <= 1
    return (
        F.when(F.size(a) == F.size(b), replaced)
        .when(F.size(a) == F.size(b) + 1, shorter(a, b))
        .when(F.size(a) + 1 == F.size(b), shorter(b, a))
        .otherwise(False)
    )


def _hinted(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if common.small_rows(df, BROADCAST_KEYS) else df


def _with_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The lines (_h1, _h2, _place) with their words, cut out of their documents alone."""
    picked = F.struct("_place._line", *LINE)
    by_doc = wanted.groupBy("_place._id", "_place._key").agg(F.collect_list(picked).alias("_picked"))
    by_doc = scale.stage(by_doc.toDF("_id", "_key", "_picked"))
    if (by_doc.agg(F.sum(F.size("_picked"))).first()[0] or 0) <= BROADCAST_KEYS:
        by_doc = F.broadcast(by_doc)
    held = common.join_on(docs, by_doc, ["_id", "_key"], "inner")

    def cut(split: Column) -> Column:
        return F.transform("_picked", lambda x: F.struct(x["_line"].alias("_line"), *[x[h].alias(h) for h in LINE], _words_of(F.get(split, x["_line"])).alias("_words")))

    rows = held.select("_id", "_key", F.explode(bind(_lines_of(F.col("_text")), cut)).alias("_at"))
    rows = rows.select("_id", "_key", "_at.*").select(*LINE, "_words", place().alias("_place"))
    # Documents equal in id and text give the same rows.
    return rows.groupBy(*LINE).agg(F.first("_words").alias("_words"), F.first("_place").alias("_place"))


def edited(docs: DataFrame, narrow: DataFrame) -> DataFrame:
    """_h1, _h2 of the lines that have an earlier line one word away.

    ``narrow`` has the lines of ``docs`` without their words, with the hashes of their ends.
    """
    exploded = narrow.select(F.explode("_ends").alias("_end"), *LINE, place().alias("_place"))
    shared = (
        exploded.groupBy("_end")
        .agg(F.min("_h1").alias("_low"), F.max("_h1").alias("_high"))
        .where("_low <> _high")
        .select("_end")
    )
    shared = _hinted(scale.stage(shared))
    wanted = exploded.join(shared, "_end", "left_semi").groupBy(*LINE).agg(F.min("_place").alias("_place"))
    tried = scale.stage(_with_words(docs, wanted))
    keys = tried.select(*LINE, F.explode(neighbourhood(F.col("_words"))).alias("_k")).select(*LINE, "_k.key", "_k.at")
    met = keys.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")
    met = _hinted(scale.stage(met))
    keys = keys.join(met, "key", "left_semi").join(tried.select(*LINE, "_place"), LINE)
    keys = scale.stage(keys)
    found = F.struct("_place", *LINE)
    first = keys.groupBy("key", "at").agg(F.min(found).alias("_first"))
    cut = first.where("at > 0").groupBy("key").agg(F.min("_first").alias("_first"))
    # Replaced: without the same word; deleted from: the whole line; inserted into: the cut ones.
    links = [
        keys.where("at > 0").join(first.where("at > 0"), ["key", "at"]),
        keys.where("at > 0").join(first.where("at = 0").drop("at"), "key"),
        keys.where("at = 0").join(cut, "key"),
    ]
    made = None
    for link in links:
        part = link.where(F.col("_first._place") < F.col("_place")).select(*LINE, F.col("_first._h1").alias("_e1"), F.col("_first._h2").alias("_e2"))
        made = part if made is None else made.union(part)
    earlier = tried.select(F.col("_h1").alias("_e1"), F.col("_h2").alias("_e2"), F.col("_words").alias("_earlier"))
    return (
        made.distinct()
        .join(tried.select(*LINE, "_words"), LINE)
        .join(earlier, ["_e1", "_e2"])
        .where(one_edit(F.col("_words"), F.col("_earlier")))
        .select(*LINE)
        .distinct()
    )


def without_seen_lines(
    docs: DataFrame, id: str = "doc_id", text: str = "text", out: tuple[str, str, str] = ("_n_lines", "_n_exact", "_n_edited")
) -> DataFrame:
    """The documents with their text freed of lines seen before, and three columns
    ``out``: how many lines there were, went as equal and went as edited ones. Columns
    of the input with these three names are replaced, all others kept."""
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"), common.text_key(F.col(text)).alias("_key"))
    found = lines(rows)
    long = F.when(F.size("_words") >= FUZZY_WORDS, ends(F.col("_words")))
    narrow = scale.stage(found.select("_id", "_key", "_line", *LINE, long.alias("_ends")))
    gone = scale.stage(edited(rows, narrow).withColumn("_edited", F.lit(True)))
    narrow = narrow.drop("_ends")
    first = narrow.groupBy(*LINE).agg(F.min(place()).alias("_first"), F.max(place()).alias("_last"))
    told = (
        first.join(gone, LINE, "left")
        .where("_edited OR _first <> _last")
        .select(*LINE, "_first", F.coalesce("_edited", F.lit(False)).alias("_edited"))
    )
    # Written first, so that it can be broadcast or, beyond that, hot lines be split.
    told = _hinted(scale.stage(told))
    went = (
        narrow.join(told, LINE)
        .where(F.col("_edited") | (place() != F.col("_first")))
        .select("_id", "_key", "_line", F.col("_edited") & (place() == F.col("_first")))
        .toDF("_id", "_key", "_line", "_is_edited")
        .groupBy("_id", "_key")
        .agg(
            F.collect_set("_line").alias("_gone"),
            F.count_distinct(F.when(F.col("_is_edited"), F.col("_line"))).alias("_n_edited"),
        )
    )
    keys = [common.free_name(x, docs.columns) for x in ("_id", "_key")]
    gone, edits = (common.free_name(x, docs.columns) for x in ("_gone", "_edits"))
    named = docs.withColumns(dict(zip(keys, (F.col(id), common.text_key(F.col(text))))))
    both = common.join_on(named, went.select("_id", "_key", "_gone", "_n_edited").toDF(*keys, gone, edits), keys, "left")
    all_lines = F.split(text, "\n")
    kept = F.when(
        F.col(gone).isNotNull(),
        F.array_join(F.filter(all_lines, lambda x, i: ~F.array_contains(gone, i)), "\n"),
    ).otherwise(F.col(text))
    n_edited = F.coalesce(F.col(edits), F.lit(0))
    return both.withColumns({
        out[0]: F.when(F.col(text).isNull(), 0).otherwise(F.size(all_lines)),
        out[1]: F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone) - n_edited),
        out[2]: n_edited,
        text: kept,
    }).drop(*keys, gone, edits)
