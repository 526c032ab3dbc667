"""Feed head, re-ranking and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.fixed_values import FEED_DEFAULT_N, FEED_MAX_N, FEED_MIN_N
from feedloom.operators import scale

REPORT = ["title", "url", "original_rank", "rank", "change", "score"]


def feed_head(
    feed: DataFrame,
    n: int | None = None,
    pos: str = "feed_pos",
    first: int | None = 1,
    low: int = FEED_MIN_N,
    high: int = FEED_MAX_N,
    default: int = FEED_DEFAULT_N,
) -> DataFrame:
    """The first ``n`` rows of a feed, ``n`` held in its allowed range.

    With dense positions counted from ``first`` this is a comparison on a
    scanned column, pushed to the reader, so later costly steps see the head
    only. With gaps in the positions pass ``first=None``.
    """
    n = min(max(default if n is None else n, low), high)
    if first is None:
        return feed.orderBy(pos).limit(n)
    return feed.where(F.col(pos) < first + n)


def with_original_rank(feed: DataFrame, order: list[str], out: str = "original_rank") -> DataFrame:
    """1-based place in the feed order, for a feed of any length; ``order``
    ends in a unique column. Dense positions are ranks already."""
    return scale.ordered_positions(feed, [F.col(c) for c in order], out=out)


def re_rank(scored: DataFrame, by: str = "profile_id") -> DataFrame:
    """Rank the stories of each request by falling score.

    Equal scores keep feed order and every story has its own rank. A request
    holds at most FEED_MAX_N stories, which bounds the window's groups; for a
    whole corpus use ``re_rank_corpus``.
    """
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.asc("original_rank"))
    return _with_change(scored.withColumn("rank", F.row_number().over(order).cast("bigint")))


def re_rank_corpus(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``re_rank`` for any number of rows: a range sort over all tasks.

    The scores are staged, since the sort reads its input twice (once to sample
    its ranges) and scoring is the costly part.
    """
    ranked = scale.ordered_positions(scale.stage(scored), [F.desc("score"), F.asc("original_rank")], by=by, out="rank")
    return _with_change(ranked)


def _with_change(ranked: DataFrame) -> DataFrame:
    """Positive change: the story moved up."""
    return ranked.withColumn("change", F.col("original_rank") - F.col("rank"))


def rerank_report(ranked: DataFrame, by: str = "profile_id") -> DataFrame:
    """The reported columns; the rows of a request together and in rank order.

    Ranking has brought the rows of a request into one partition already, so
    no further shuffle is needed.
    """
    return ranked.select(by, *REPORT).sortWithinPartitions(by, "rank")
