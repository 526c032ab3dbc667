"""Rank the candidate queries of each question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.fixed_values import QUESTION_DEFAULT_N, QUESTION_MAX_N, QUESTION_MIN_N
from feedloom.operators import similarity
from feedloom.operators.embedding import Embedder, embed


def rank_candidate_queries(
    questions: DataFrame, candidates: DataFrame, embedder: Embedder | None = None
) -> DataFrame:
    """The best queries of each question, as many as it asked for.

    ``questions``: question_idx, question (rows without one are not served), n.
    ``candidates``: question_idx,
    candidate_id, query.
    """
    n = similarity.clamp(F.col("n"), QUESTION_DEFAULT_N, QUESTION_MIN_N, QUESTION_MAX_N)
    asked = questions.where(F.col("question").isNotNull()).withColumn("n", n).transform(embed, "question", "vec", embedder)
    offered = candidates.transform(embed, "query", "vec", embedder)
    return similarity.topk_candidates(asked.drop("question"), offered, k=QUESTION_MAX_N)
