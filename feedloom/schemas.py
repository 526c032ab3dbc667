"""Explicit schemas of every table the jobs read or write."""

from __future__ import annotations

from pyspark.sql import types as T

LONG, INT, TEXT, DOUBLE = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


STORIES = _table(id=LONG, title=TEXT, url=TEXT, feed_pos=LONG)
STORY_ITEMS = _table(id=LONG, title=TEXT, url=TEXT)
FEED_IDS = _table(id=LONG, feed_pos=LONG)
PAGES = _table(url=TEXT, status=INT, html=TEXT, error=TEXT)
TEXT_CACHE = _table(url_key=TEXT, text=TEXT)
VECTOR_CACHE = _table(text_key=TEXT, vec=T.ArrayType(T.FloatType()))
REQUESTS = _table(profile_id=LONG, profile=TEXT, n=INT)
RERANKED = _table(
    profile_id=LONG, title=TEXT, url=TEXT, original_rank=LONG, rank=LONG, change=LONG, score=DOUBLE
)
QUESTIONS = _table(question_idx=LONG, question=TEXT, n=INT)
CANDIDATES = _table(question_idx=LONG, candidate_id=LONG, query=TEXT)
RESPONSES = _table(model=TEXT, iteration=LONG, question_idx=LONG, prompt=TEXT, response=TEXT)
RECORDS = _table(
    model=TEXT,
    iteration=LONG,
    question_idx=LONG,
    question=TEXT,
    output=T.ArrayType(TEXT),
    inference_time=DOUBLE,
    loading_time=DOUBLE,
)
ANSWERS = _table(response=TEXT, inference_time=DOUBLE, loading_time=DOUBLE, error=TEXT)
MODEL_ERRORS = _table(model=TEXT, error=TEXT)

# The test tables the queries read.
TEST_TABLES = {
    "pages": _table(page_id=LONG, url=TEXT, html=TEXT),
    "documents": _table(doc_id=LONG, text=TEXT, lang=TEXT, source=TEXT, n_chars=LONG),
    "labels": _table(doc_id=LONG, quality=INT, toxic=INT),
    "embeddings": _table(vec_id=LONG, embedding=T.ArrayType(T.FloatType()), label=INT),
    "benchmark": _table(item_id=LONG, text=TEXT),
    "conversations": _table(conv_id=LONG, turn=LONG, role=TEXT, text=TEXT),
    "events": _table(
        event_id=LONG, ts=T.TimestampNTZType(), user_id=LONG, event_type=TEXT, value=DOUBLE, props=TEXT
    ),
    "orders": _table(
        o_orderkey=LONG, o_custkey=LONG, o_orderstatus=TEXT, o_totalprice=DOUBLE, o_orderdate=T.TimestampNTZType(), o_orderpriority=TEXT
    ),
    "lineitem": _table(
        l_orderkey=LONG, l_partkey=LONG, l_suppkey=LONG, l_linenumber=INT, l_quantity=DOUBLE, l_extendedprice=DOUBLE, l_discount=DOUBLE,
        l_tax=DOUBLE, l_returnflag=TEXT, l_linestatus=TEXT, l_shipdate=T.TimestampNTZType(),
    ),
}
