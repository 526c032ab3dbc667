"""Re-rank a feed for the people who asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.fixed_values import FEED_MAX_N
from feedloom.operators import corpus, ranking, scale, similarity
from feedloom.operators.embedding import Embedder, embed


# A joined row may hold a text of the longest allowed length.
TEXT_BYTES = 200_000


def story_vectors(stories: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Bodies and vectors of stories that have ``title`` and resolved ``text``."""
    return stories.transform(corpus.story_bodies).transform(embed, "body", "vec", embedder)


def attach_pages(stories: DataFrame, pages: DataFrame) -> DataFrame:
    """The text of each story's page; null when there is no usable page.

    ``pages`` has one row per url. For a head of the feed the wanted urls are
    broadcast: pages are read once, filtered, and only then is their HTML turned
    into text. Texts themselves are wide and never broadcast on purpose. For a
    whole feed both sides are shuffled, hot and missing urls dealt out.
    """
    urls = stories.select("url").where(F.col("url").isNotNull())
    few = scale.fits(urls)
    wanted = pages.join(F.broadcast(urls), "url", "left_semi") if few else pages
    texts = wanted.transform(corpus.extract_text).transform(corpus.resolve_fetch).select("url", "text")
    if few:
        return stories.join(texts, "url", "left")
    return scale.salted_join(stories, texts, ["url"], ["id"], "left", row_bytes=TEXT_BYTES)


def rerank_feed(
    stories: DataFrame, requests: DataFrame, embedder: Embedder | None = None, limit: int = FEED_MAX_N
) -> DataFrame:
    """Report per request: the first ``n`` stories in order of their score.

    ``stories``: id, title, url, text, feed_pos (dense, from 1).
    ``requests``: profile_id, profile (requests without one are not served), n.
    ``limit`` is the longest head a request may ask for, the rule of the feed;
    stories beyond it are not embedded.
    """
    requests = similarity.valid_requests(requests, limit)
    head = stories.where(F.col("feed_pos") <= limit)
    vectors = story_vectors(head, embedder).select("id", "title", "url", "feed_pos", "vec")
    profiles = requests.where(F.col("profile").isNotNull()).transform(embed, "profile", "vec", embedder).select("profile_id", "n", "vec")
    scored = similarity.score_requests(vectors, profiles)
    return ranking.rerank_report(ranking.re_rank(scored))


def rerank_corpus(stories: DataFrame, profile: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Report for one profile over a feed of any length.

    Bodies and vectors do not leave their task; only ids, positions and scores
    are sorted.
    """
    vectors = story_vectors(stories, embedder).select("title", "url", F.col("feed_pos").alias("original_rank"), "vec")
    scored = similarity.score_corpus(vectors, profile.transform(embed, "profile", "vec", embedder))
    return ranking.re_rank_corpus(scored).select(*ranking.REPORT)
