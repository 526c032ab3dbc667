"""Language identification by a mixture of languages per document.

A document is a bag of words, each written in one of its languages. A language
gives a word the product of its character trigrams' probabilities, trigrams being
hashed into BUCKETS. Expectation-maximisation finds the proportions of all
languages; the set of languages is then chosen among the most likely one, two, ...
by the likelihood that each set reaches less PENALTY times log(words) for each
language more. The answer is the chosen language of the largest proportion, which
is the score.

Fitting counts trigrams over at most TRAIN_DOCS labelled documents per language,
those with the least hashes of their ids, and learns every language that has one. Up
to DENSE_LANGUAGES of them a table of BUCKETS floats per language goes to every task;
with more, eight bytes for each trigram that a language has, and equal words of a
text are judged once. Prediction reads whole texts where they lie, without a shuffle.

``judged`` also learns how likely a language's own documents are: the mean of their
log likelihoods per trigram, each without its own counts, and how it spreads between
documents and between words. A text is implausible if its log likelihood under its
mixture is more than SPREADS of these below, as in a language that was not learned.

Edge cases: a text that is null or has no letter is ``und`` with score 0, and so
is every text if there is nothing to learn from. Equal likelihoods go to the
language that sorts first. Texts are worked through in slices of CHUNK characters,
so a long one needs little memory. Other columns are ignored or kept as asked.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm import common
from feedloom.operators import scale

BUCKETS = 1 << 16
TRAIN_DOCS = 1_000
DENSE_LANGUAGES = 200
# Languages of which a task counts trigrams at a time.
HELD_LANGUAGES = 64
# Cells (words times languages) made at a time where the table is sparse.
CELLS = 1 << 18
BROADCAST_IDS = 1_000_000
SMOOTHING = 0.05
PENALTY = 2.0
CHUNK = 1 << 20
STEPS = 50
# Languages with less of a document are not tried as members of its set.
LEAST_SHARE = 0.01
# Deviations below the usual likelihood at which a text is in none of its languages.
SPREADS = 10.0
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters, one entry for each of Unicode's."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's trigrams and the first one of each word.

    A word is a run of letters; its trigrams include one blank before and after.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[np.minimum(codes, 0x10FFFF)]
    codes = np.where(letter, codes, 0).astype(np.uint32)
    kept = letter | np.concatenate([[False], letter[:-1]])
    c = np.concatenate([[0], codes[kept], [0]]).astype(np.uint32)
    mixed = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    inside = c[1:-1] > 0
    first = np.flatnonzero((c[:-2] == 0)[inside])
    return (mixed >> np.uint32(16))[inside], first


def slices(text: str) -> Iterator[str]:
    for at in range(0, len(text), CHUNK):
        yield text[at : at + CHUNK]


# Their sum names the trigrams of a word, in any order.
_NAMES = np.random.default_rng(11).integers(0, 1 << 64, BUCKETS, dtype=np.uint64)


@dataclass
class Sparse:
    """Log probabilities by bucket: those of the languages that have it, the others' base."""

    base: np.ndarray  # per language
    starts: np.ndarray  # per bucket, and the end
    language: np.ndarray
    above: np.ndarray  # log probability less the base

    def sums(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log likelihood of each word in each language."""
        sizes = np.diff(np.append(first, len(buckets)))
        words = np.repeat(np.arange(len(first)), sizes)
        held = self.starts[buckets + 1] - self.starts[buckets]
        at = np.repeat(self.starts[buckets] - (np.cumsum(held) - held), held) + np.arange(held.sum())
        cells = np.repeat(words, held) * len(self.base) + self.language[at]
        out = np.bincount(cells, self.above[at], len(first) * len(self.base)).reshape(len(first), -1)
        return (out + sizes[:, None] * self.base).astype(np.float32)


@dataclass
class Model:
    """Log probability of each trigram bucket (rows) in each language (columns)."""

    languages: list[str]
    table: np.ndarray | Sparse
    # Per language: mean log likelihood a trigram, deviation between documents (per
    # trigram) and between words (per word); null if it was not asked for.
    usual: np.ndarray | None = None
    # Trigrams counted per language, with the smoothing of all buckets.
    totals: np.ndarray | None = None

    def column(self, k: int) -> np.ndarray:
        """Log probability of each bucket in one language."""
        if not isinstance(self.table, Sparse):
            return self.table[:, k].astype(float)
        own = self.table.language == k
        out = np.full(BUCKETS, self.table.base[k])
        out[np.repeat(np.arange(BUCKETS), np.diff(self.table.starts))[own]] += self.table.above[own]
        return out

    def counted(self, text: str) -> tuple[np.ndarray, np.ndarray | None]:
        """``words`` and how often each occurs, null if each is one occurrence."""
        if not isinstance(self.table, Sparse):
            return self.words(text), None
        held: dict[int, list] = {}
        for part in slices(text):
            buckets, first = trigrams(part)
            if not len(first):
                continue
            ends = np.append(first[1:], len(buckets))
            names, at, times = np.unique(np.add.reduceat(_NAMES[buckets], first), return_index=True, return_counts=True)
            for name, i, n in zip(names.tolist(), at.tolist(), times.tolist()):
                if name in held:
                    held[name][1] += n
                else:
                    held[name] = [buckets[first[i] : ends[i]].astype(np.int64), n]
        parts, found, step = list(held.values()), [], max(1, CELLS // len(self.languages))
        for i in range(0, len(parts), step):
            own = [x for x, _ in parts[i : i + step]]
            found.append(self.table.sums(np.concatenate(own), np.cumsum([0, *map(len, own[:-1])])))
        none = np.zeros((0, len(self.languages)), np.float32)
        return np.concatenate(found) if found else none, np.array([n for _, n in parts], float)

    def words(self, text: str) -> np.ndarray:
        """Log likelihood of each word in each language."""
        found = []
        for part in slices(text):
            buckets, first = trigrams(part)
            if len(first):
                found.append(np.add.reduceat(self.table[buckets], first, axis=0))
        return np.concatenate(found) if found else np.zeros((0, len(self.languages)), np.float32)

    def mixture(self, text: str | None) -> dict[str, float]:
        """The document's languages and their proportions; empty if unknown."""
        words, times = self.counted(text or "") if self.languages else (np.zeros((0, 0)), None)
        return self.chosen(words, times)

    def chosen(self, words: np.ndarray, times: np.ndarray | None) -> dict[str, float]:
        if not len(words):
            return {}
        count = len(words) if times is None else times.sum()
        likely = np.exp(words - words.max(1, keepdims=True))
        share = proportions(likely, np.full(likely.shape[1], 1 / likely.shape[1]), times)
        order = np.argsort(-share, kind="stable")
        tried = order[: max(1, int((share >= LEAST_SHARE).sum()))]
        best, chosen = -np.inf, {}
        for n in range(1, len(tried) + 1):
            members = tried[:n]
            own = share[members] / share[members].sum()
            if n > 1:
                own = proportions(likely[:, members], own, times)
            logs = np.log(np.maximum(likely[:, members] @ own, 1e-300))
            reached = (logs.sum() if times is None else logs @ times) - PENALTY * (n - 1) * np.log(count + 1)
            if reached > best:
                best, chosen = reached, dict(zip([self.languages[i] for i in members], own.tolist()))
        return chosen

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language and score, and whether the text is as likely as those learned."""
        words, times = self.counted(text or "") if self.languages else (np.zeros((0, 0)), None)
        found = self.chosen(words, times)
        if not found:
            return UNKNOWN, 0.0, False
        members, share = [self.languages.index(x) for x in found], np.array(list(found.values()))
        own = words[:, members].astype(float)
        most = own.max(1)
        logs = most + np.log(np.maximum(np.exp(own - most[:, None]) @ share, 1e-300))
        n = len(words) if times is None else float(times.sum())
        reached = logs.sum() if times is None else float(logs @ times)
        size = sum(len(trigrams(part)[0]) for part in slices(text))
        mean, between, within = share @ self.usual[members]
        # Not knowing the language of each word costs up to the entropy of the shares.
        mixed = -n * float((share * np.log(np.maximum(share, 1e-300))).sum())
        plausible = reached >= mean * size - mixed - SPREADS * (between * size + within * np.sqrt(n))
        language = max(found, key=found.get)
        return language, min(1.0, max(0.0, found[language])), bool(plausible)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.mixture(text)
        if not found:
            return UNKNOWN, 0.0
        language = max(found, key=found.get)
        return language, min(1.0, max(0.0, found[language]))


def proportions(likely: np.ndarray, share: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """Expectation-maximisation of the shares of the columns of ``likely``, whose
    rows occur so many times."""
    enough = min(1e-3, 0.5 / len(share))
    for _ in range(STEPS):
        weighted = likely * share
        weighted /= np.maximum(weighted.sum(1, keepdims=True), 1e-300)
        new = weighted.mean(0) if times is None else times @ weighted / times.sum()
        done = np.abs(new - share).max() < enough
        share = new
        if done:
            break
    return share


def held_out(id: Column, parts: int = 5) -> Column:
    """Whether a document is kept from learning, by the CRC of its id."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % parts == 0, F.lit(False))


def fit(labelled: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = TRAIN_DOCS) -> Model:
    """Learn from the labelled rows: text and language not null."""
    return counts_of(sampled(labelled, id, text, lang, per_language))


def sampled(labelled: DataFrame, id: str, text: str, lang: str, per_language: int) -> DataFrame:
    """_lang, _text of the documents to learn from."""
    rows = labelled.select(
        F.col(id).cast("string").alias("_id"), F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang")
    ).where("_text IS NOT NULL AND _lang IS NOT NULL")
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    ids = rows.select("_lang", "_id", F.row_number().over(order).alias("_rank"))
    ids = scale.stage(ids.where(F.col("_rank") <= per_language).select("_lang", "_id").distinct())
    if common.small_rows(ids, BROADCAST_IDS):
        ids = F.broadcast(ids)
    return rows.join(ids, ["_lang", "_id"], "left_semi").select("_lang", "_text")


def counts_of(sample: DataFrame) -> Model:
    """The model of the sample's trigrams."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        counts: dict[str, np.ndarray] = {}

        def told() -> Iterator[dict[str, list]]:
            for language, total in counts.items():
                used = np.flatnonzero(total)
                yield {"lang": [language] * len(used), "bucket": used, "n": total[used]}
            counts.clear()

        for batch in batches:
            for language, value in zip(batch.column("_lang").to_pylist(), batch.column("_text").to_pylist()):
                if language not in counts and len(counts) == HELD_LANGUAGES:
                    yield from told()
                total = counts.setdefault(language, np.zeros(BUCKETS, np.int64))
                for part in slices(value):
                    total += np.bincount(trigrams(part)[0], minlength=BUCKETS)
        yield from told()

    sums = common.arrow_map(sample, tally, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # A row per language, of at most BUCKETS numbers.
    told = sums.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n")).toArrow()
    told = told.sort_by("lang").combine_chunks()
    own = [
        (told["bucket"][k].values.to_numpy(), told["n"][k].values.to_numpy()) for k in range(told.num_rows)
    ]
    return tabled(told["lang"].to_pylist(), own)


def tabled(languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model of each language's trigram buckets and their counts."""
    totals = np.array([n.sum() for _, n in counts]) + SMOOTHING * BUCKETS
    if len(languages) > DENSE_LANGUAGES:
        buckets = np.concatenate([b for b, _ in counts])
        order = np.argsort(buckets, kind="stable")
        language = np.repeat(np.arange(len(counts), dtype=np.int32), [len(b) for b, _ in counts])[order]
        above = np.concatenate([np.log1p(n / SMOOTHING).astype(np.float32) for _, n in counts])[order]
        starts = np.concatenate([[0], np.cumsum(np.bincount(buckets, minlength=BUCKETS))])
        return Model(languages, Sparse(np.log(SMOOTHING / totals), starts, language, above), totals=totals)
    table = np.full((BUCKETS, len(languages)), SMOOTHING)
    for k, (bucket, n) in enumerate(counts):
        table[bucket, k] += n
    table = np.log(table / table.sum(0)) if languages else table
    return Model(languages, table.astype(np.float32), totals=totals)


def judged(labelled: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = TRAIN_DOCS) -> Model:
    """A model that also knows how likely its languages' documents usually are."""
    sample = sampled(labelled, id, text, lang, per_language)
    model = counts_of(sample)
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        place = {x: k for k, x in enumerate(sent.value.languages)}
        columns: dict[int, tuple[np.ndarray, float]] = {}
        for batch in batches:
            out: dict[str, list] = {"lang": [], "mean": [], "within": []}
            for language, value in zip(batch.column("_lang").to_pylist(), batch.column("_text").to_pylist()):
                if language not in place:
                    continue
                k = place[language]
                if k not in columns:
                    if len(columns) == HELD_LANGUAGES:
                        columns.clear()
                    total = float(sent.value.totals[k])
                    columns[k] = np.exp(sent.value.column(k)) * total, total
                held, total = columns[k]
                parts = [trigrams(part) for part in slices(value)]
                own = sum(np.bincount(b, minlength=BUCKETS) for b, _ in parts)
                size = sum(len(b) for b, _ in parts)
                if not size:
                    continue
                left = np.log(np.maximum(held - own, SMOOTHING) / max(total - size, SMOOTHING * BUCKETS))
                words = np.concatenate([np.add.reduceat(left[b], f) for b, f in parts if len(f)])
                sizes = np.concatenate([np.diff(np.append(f, len(b))) for b, f in parts if len(f)])
                mean = words.sum() / size
                out["lang"].append(language)
                out["mean"].append(float(mean))
                out["within"].append(float(np.sqrt(((words - mean * sizes) ** 2).mean())))
            yield out

    made = common.arrow_map(sample, measure, "lang string, mean double, within double").groupBy("lang").agg(
        F.percentile("mean", F.lit(0.5)).alias("mean"),
        # Of a normal spread 16 % lie more than one deviation below; a few odd documents do not matter.
        (F.percentile("mean", F.lit(0.5)) - F.percentile("mean", F.lit(0.16))).alias("between"),
        F.percentile("within", F.lit(0.5)).alias("within"),
    )
    told = {r["lang"]: (r["mean"], r["between"], r["within"]) for r in made.toArrow().to_pylist()}
    # Of a language without any letter nothing is usual.
    model.usual = np.array([told.get(x, (-np.inf, 0.0, 0.0)) for x in model.languages]).reshape(-1, 3)
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", out: tuple[str, ...] = ("lang_pred", "score"), keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) and the language and score of each text,
    and whether it is plausible if ``out`` names a third column; see ``judged``."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in out]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    read = common.free_name("_read_text", docs.columns)
    rows = docs.select(*keep, F.col(text).alias(read))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        ask = sent.value.judge if len(out) > 2 else sent.value.predict
        for batch in batches:
            for part in common.sliced(batch):
                found = [ask(x.as_py()) for x in part.column(read)]
                yield {c: part.column(c) for c in keep} | dict(zip(out, map(list, zip(*found))))

    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return common.arrow_map(rows, predict, ", ".join([*kept, *(f"`{c}` {t}" for c, t in zip(out, ("string", "double", "boolean")))]))


def learned(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", judging: bool = False) -> Model:
    """A model of the documents that are not held out, with ``judging`` one that
    tells implausible texts."""
    return (judged if judging else fit)(docs.where(F.col(id).isNotNull() & ~held_out(F.col(id))), id, text, lang)
