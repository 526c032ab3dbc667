"""Scoring by cosine, and top candidates per question.

Vectors may be sparse counts or dense floats; the column type tells which.
No step pairs all rows of one side with all rows of the other: requests name
the feed positions they cover, and candidates name their question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.fixed_values import (
    FEED_DEFAULT_N,
    FEED_MAX_N,
    FEED_MIN_N,
    TOP_K,
)
from feedloom.functions import vectors as vx
from feedloom.operators import scale
from feedloom.operators.embedding import Embedder, embed


# Two vectors of 384 numbers in a joined row.
VECTOR_BYTES = 8_192


def _is_sparse(df: DataFrame, vec: str) -> bool:
    return isinstance(df.schema[vec].dataType.elementType, T.StructType)


def _measured(df: DataFrame, vec: str, prefix: str, densify: bool, dim: int) -> DataFrame:
    """Replace a vector by the form the scoring uses and add its length, once
    per row and before any join repeats it."""
    sparse = _is_sparse(df, vec)
    form = vx.dense_counts(vec, dim) if sparse and densify else F.col(vec)
    length = vx.sparse_norm(vec) if sparse else vx.dense_norm(vec)
    others = [c for c in df.columns if c != vec]
    return df.select(*others, form.alias(f"{prefix}_vec"), length.alias(f"{prefix}_norm"))


def _score(sparse: bool) -> Column:
    """Cosine of an item against a query, both measured."""
    return vx.measured_cosine("_item_vec", "_item_norm", "_query_vec", "_query_norm", sparse)


def clamp(n: Column, default: int, low: int, high: int) -> Column:
    """A requested number: the default when absent, else held in its range."""
    return F.least(F.greatest(F.coalesce(n, F.lit(default)), F.lit(low)), F.lit(high))


def valid_requests(requests: DataFrame, limit: int = FEED_MAX_N) -> DataFrame:
    """Requests with ``n`` held in its range: the one place where a feed head is
    limited. ``limit`` is the longest head a request may ask for."""
    return requests.withColumn("n", clamp(F.col("n"), FEED_DEFAULT_N, FEED_MIN_N, limit))


def score_requests(
    stories: DataFrame,
    requests: DataFrame,
    pos: str = "feed_pos",
    vec: str = "vec",
    dim: int = vx.DIM,
) -> DataFrame:
    """One row per request and story of its feed head, with ``score``.

    ``stories`` has 1-based positions; ``requests`` has ``profile_id``, ``n`` and
    a vector. A request expands to the ``n`` positions it covers and meets the
    stories in an equi-join, whatever ``n`` is. Stories counted to be few are
    broadcast; else both sides shuffle, positions that many requests cover being
    salted. The requests are dealt out by ``profile_id`` before they expand.
    """
    sparse = _is_sparse(stories, vec)
    reach = _measured(stories, vec, "_item", False, dim)
    n = F.col("n")
    # A number of partitions is given because a request grows to hundreds of
    # rows: adaptive coalescing would judge by the size before that.
    parts = scale.shuffle_partitions(requests.sparkSession)
    asked = (
        _measured(requests.repartition(parts, "profile_id"), vec, "_query", True, dim)
        .where(n >= 1)
        .select("profile_id", "_query_vec", "_query_norm", F.explode(F.sequence(F.lit(1), n)).alias(pos))
        .withColumn(pos, F.col(pos).cast("bigint"))
    )
    scored = scale.keyed_join(asked, reach, [pos], ["profile_id"], row_bytes=VECTOR_BYTES).withColumn("score", _score(sparse))
    kept = [c for c in stories.columns if c not in (vec, pos)]
    return scored.select("profile_id", F.col(pos).alias("original_rank"), *kept, "score")


def score_keyed(
    stories: DataFrame,
    requests: DataFrame,
    key: str,
    story_id: str = "id",
    vec: str = "vec",
    dim: int = vx.DIM,
) -> DataFrame:
    """One row per request and story of its set, with ``score``; no limit.

    Both sides name the set by ``key`` (a feed, label or language): an equi-join,
    in which sets of many stories are salted by ``story_id``.
    """
    sparse = _is_sparse(stories, vec)
    asked = _measured(requests.select("profile_id", key, vec), vec, "_query", True, dim)
    items = _measured(stories, vec, "_item", False, dim)
    joined = scale.keyed_join(items, asked, [key], [story_id], row_bytes=VECTOR_BYTES)
    kept = [c for c in stories.columns if c not in (vec, key)]
    return joined.select("profile_id", key, *kept, _score(sparse).alias("score"))


def score_static(items: DataFrame, requests: DataFrame, key: str, vec: str = "vec", dim: int = vx.DIM) -> DataFrame:
    """``score_keyed`` for a stream of items and a static table of requests (profile_id,
    ``key``, vec): nothing is counted or written on the way, so it can be planned
    before there are rows."""
    sparse = _is_sparse(items, vec)
    asked = _measured(requests.select("profile_id", key, vec), vec, "_query", True, dim)
    joined = _measured(items, vec, "_item", False, dim).join(asked, key)
    kept = [c for c in items.columns if c not in (vec, key)]
    return joined.select("profile_id", key, *kept, _score(sparse).alias("score"))


def score_corpus(items: DataFrame, profile: DataFrame, vec: str = "vec", dim: int = vx.DIM) -> DataFrame:
    """Score every row of a corpus against one profile.

    ``profile`` has exactly one row; it enters as scalar subqueries, so the
    corpus is only scanned and mapped.
    """
    sparse = _is_sparse(items, vec)
    query = _measured(profile.select(vec), vec, "_query", True, dim)
    kept = [c for c in items.columns if c != vec]
    return (
        _measured(items, vec, "_item", False, dim)
        .withColumn("_query_vec", query.select("_query_vec").scalar())
        .withColumn("_query_norm", query.select("_query_norm").scalar())
        .select(*kept, _score(sparse).alias("score"))
    )


def topk_candidates(
    questions: DataFrame,
    candidates: DataFrame,
    k: int = TOP_K,
    key: str = "question_idx",
    candidate_id: str = "candidate_id",
    vec: str = "vec",
    dim: int = vx.DIM,
    broadcast_rows: int = scale.BROADCAST_ROWS,
    heavy_rows: int = scale.HEAVY_ROWS,
) -> DataFrame:
    """The ``k`` candidates of each question with the highest cosine.

    Equal scores keep the order of ``candidate_id``; a question with fewer
    candidates returns them all. The join is on the question; the row limit is
    applied map-side first, so a hot question ships ``k`` rows per task. A
    question may ask for fewer with a column ``n``.
    """
    sparse = _is_sparse(candidates, vec)
    asked = [c for c in questions.columns if c not in (vec,)]
    pairs = scale.keyed_join(
        _measured(candidates, vec, "_item", False, dim),
        _measured(questions.select(*asked, vec), vec, "_query", True, dim),
        [key],
        [candidate_id],
        broadcast_rows=broadcast_rows,
        min_rows=heavy_rows,
    )
    scored = pairs.withColumn("score", _score(sparse)).drop("_item_vec", "_item_norm", "_query_vec", "_query_norm")
    best = Window.partitionBy(key).orderBy(F.desc("score"), F.asc(candidate_id))
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ranked = ranked.withColumn("rank", F.col("rank").cast("bigint"))
    if "n" in questions.columns:
        ranked = ranked.where(F.col("rank") <= F.col("n"))
    return ranked


def best_sentences(items: DataFrame, profile: DataFrame, id: str, text: str = "text", embedder: Embedder | None = None) -> DataFrame:
    """The sentence of each text that is most like the profile, with its score.

    A sentence ends at ".", "!", "?" or a line break. Sentences are scored where
    their text lies, and each task keeps the best per row: no pair of rows meets.
    Of equal scores the first sentence wins; texts without a sentence are left out.
    """
    sentences = (
        items.select(id, F.posexplode(F.split(text, r"[.!?\n]+")).alias("_no", "_sentence"))
        .withColumn("_sentence", F.trim("_sentence"))
        .where(F.col("_sentence") != "")
        .transform(embed, "_sentence", "vec", embedder)
    )
    scored = score_corpus(sentences, profile)
    order = F.struct(F.col("score"), -F.col("_no"))
    best = scored.groupBy(id).agg(F.max_by(F.struct("_sentence", "score"), order).alias("_best"))
    return best.select(id, F.col("_best._sentence").alias("sentence"), "_best.score")
