import math

import pytest
from pyspark.sql import functions as F

from feedloom.operators import ranking, similarity
from feedloom.operators.embedding import embed
from feedloom.plans import questions as question_plan
from feedloom.plans import rerank as rerank_plan
from test_vectors import cosine


@pytest.mark.parametrize("n,expected", [(None, 10), (0, 1), (-5, 1), (1, 1), (500, 500), (501, 500)])
@pytest.mark.parametrize("dense", [True, False])
def test_feed_head_is_clamped(spark, n, expected, dense):
    feed = spark.range(1, 701).select(F.col("id").alias("feed_pos"))
    head = ranking.feed_head(feed, n, first=1 if dense else None)
    assert sorted(r.feed_pos for r in head.collect()) == list(range(1, expected + 1))


@pytest.mark.parametrize("n,expected", [(None, 5), (0, 1), (10, 10), (11, 10)])
def test_question_numbers_are_clamped(spark, n, expected):
    column = F.lit(n).cast("int")
    assert spark.range(1).select(similarity.clamp(column, 5, 1, 10).alias("n")).first().n == expected


def test_ties_keep_feed_order_and_ranks_are_not_shared(spark):
    scored = spark.createDataFrame(
        [(1, 1, 0.5), (1, 2, 0.9), (1, 3, 0.5), (1, 4, 0.9), (2, 1, 0.0), (2, 2, 0.0)],
        "profile_id INT, original_rank LONG, score DOUBLE",
    )
    got = {(r.profile_id, r.original_rank): (r["rank"], r.change) for r in ranking.re_rank(scored).collect()}
    assert got == {(1, 2): (1, 1), (1, 4): (2, 2), (1, 1): (3, -2), (1, 3): (4, -1), (2, 1): (1, 0), (2, 2): (2, 0)}


def test_scores_of_requests_against_brute_force(spark):
    vectors = [[math.sin(i * j + 1) for j in range(4)] for i in range(30)] + [[0.0] * 4]
    stories = spark.createDataFrame([(i + 1, v) for i, v in enumerate(vectors)], "feed_pos LONG, vec ARRAY<FLOAT>")
    requests = spark.createDataFrame(
        [(1, 3, vectors[5]), (2, None, vectors[6]), (3, 9_999, vectors[7]), (4, -1, [0.0] * 4)],
        "profile_id LONG, n INT, vec ARRAY<FLOAT>",
    )
    got = {(r.profile_id, r.original_rank): r.score for r in similarity.score_requests(stories, similarity.valid_requests(requests)).collect()}
    asked = {1: (3, vectors[5]), 2: (10, vectors[6]), 3: (31, vectors[7]), 4: (1, [0.0] * 4)}
    expected = {(p, i + 1): cosine(q, vectors[i]) for p, (n, q) in asked.items() for i in range(n)}
    assert got.keys() == expected.keys()
    assert all(math.isclose(got[k], expected[k], abs_tol=1e-6) for k in got)


CANDIDATES = [(1, i, [math.cos(i * j) for j in range(1, 5)]) for i in range(50)] + [(2, 0, [1.0, 0.0, 0.0, 0.0]), (3, 0, [0.0] * 4)]


@pytest.mark.parametrize("sizes", [{}, {"broadcast_rows": 0, "heavy_rows": 10}])
def test_topk_against_brute_force(spark, sizes):
    questions = spark.createDataFrame(
        [(1, [1.0, 0.5, 0.2, 0.1]), (2, [0.5] * 4), (3, [1.0] * 4), (4, [1.0] * 4)], "question_idx INT, vec ARRAY<FLOAT>"
    )
    candidates = spark.createDataFrame(CANDIDATES, "question_idx INT, candidate_id INT, vec ARRAY<FLOAT>")
    got = similarity.topk_candidates(questions, candidates, k=3, **sizes).orderBy("question_idx", "rank").collect()
    scored = sorted((-cosine([1.0, 0.5, 0.2, 0.1], v), i) for q, i, v in CANDIDATES if q == 1)[:3]
    assert [(r.question_idx, r.candidate_id) for r in got] == [(1, i) for _, i in scored] + [(2, 0), (3, 0)]
    assert got[-1].score == 0.0


def test_candidate_queries_of_a_question(spark):
    questions = spark.createDataFrame([(1, "What is the capital of France?", 2), (2, "x", None)], "question_idx LONG, question STRING, n INT")
    candidates = spark.createDataFrame(
        [(1, 1, "Paris"), (1, 2, "capital of France"), (1, 3, "France capital")]
        + [(2, i, "x") for i in range(20)],
        "question_idx LONG, candidate_id LONG, query STRING",
    )
    got = question_plan.rank_candidate_queries(questions, candidates).orderBy("question_idx", "rank").collect()
    assert [r["query"] for r in got][:2] == ["capital of France", "France capital"]
    assert [r.candidate_id for r in got if r.question_idx == 2] == [0, 1, 2, 3, 4]


def test_rerank_end_to_end(spark):
    pages = spark.createDataFrame(
        [
            ("u1", 200, "<p>" + "rust compiler " * 30 + "</p>", None),
            ("u2", 200, "<p>" + "gardening soil " * 30 + "</p>", None),
            ("u3", 404, "<p>" + "gardening soil " * 30 + "</p>", None),
        ],
        "url STRING, status INT, html STRING, error STRING",
    )
    stories = spark.createDataFrame(
        [(11, "Rust", "u1", 1), (12, "Soil", "u2", 2), (13, "Gone", "u3", 3), (14, "Ask", None, 4), (15, None, "u1", 5)],
        "id LONG, title STRING, url STRING, feed_pos LONG",
    )
    requests = spark.createDataFrame([(1, "gardening and soil", 10)], "profile_id LONG, profile STRING, n INT")
    report = rerank_plan.rerank_feed(rerank_plan.attach_pages(stories, pages), requests)
    assert report.columns == ["profile_id", "title", "url", "original_rank", "rank", "change", "score"]
    got = report.collect()
    assert [(r.title, r.original_rank, r["rank"], r.change) for r in got] == [
        ("Soil", 2, 1, 1), ("Rust", 1, 2, -1), ("Gone", 3, 3, 0), ("Ask", 4, 4, 0)
    ]


def test_corpus_and_request_reports_agree(spark):
    stories = spark.createDataFrame(
        [(i, f"title {i % 7}", f"u{i}", f"word{i % 5} " * 80, i + 1) for i in range(120)],
        "id LONG, title STRING, url STRING, text STRING, feed_pos LONG",
    )
    profile = spark.createDataFrame([(1, "word3 title 2", 500)], "profile_id LONG, profile STRING, n INT")
    one = rerank_plan.rerank_feed(stories, profile).drop("profile_id").collect()
    other = rerank_plan.rerank_corpus(stories, profile.select("profile")).orderBy("rank").collect()
    assert [tuple(r) for r in one] == [tuple(r) for r in other]


def test_scores_have_no_limit_of_their_own(spark):
    stories = spark.createDataFrame([(i + 1, [1.0, float(i)]) for i in range(700)] + [(1, [2.0, 2.0])], "feed_pos LONG, vec ARRAY<FLOAT>")
    requests = spark.createDataFrame([(1, 600, [1.0, 1.0]), (2, 0, [1.0, 1.0])], "profile_id LONG, n INT, vec ARRAY<FLOAT>")
    got = similarity.score_requests(stories, requests).collect()
    assert len(got) == 601 and max(r.original_rank for r in got) == 600


def test_keyed_scores_meet_every_story_of_the_set(spark):
    stories = spark.createDataFrame([(i, i % 3, [1.0, float(i)]) for i in range(90)], "id LONG, k INT, vec ARRAY<FLOAT>")
    requests = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0]), (3, 2, [1.0, 1.0])], "profile_id LONG, k INT, vec ARRAY<FLOAT>")
    got = {(r.profile_id, r.id): r.score for r in similarity.score_keyed(stories, requests, "k").collect()}
    assert len(got) == 90 and abs(got[2, 3] - 3 / 10**0.5) < 1e-12
