"""The corpus pipeline: ``documents`` to packed sequences, stage by stage.

Each stage takes what its predecessor kept, as rows of ``documents`` with all
their columns; the last one returns the pieces of packed documents. Repeated rows
pass the language stage as they are, get equal texts from line dedup, and are one
document of their group in near-dedup. Null and empty texts have no language, so
they go first. Any stage takes an empty table and returns one. Further columns are kept,
whatever their names; of repeated rows that differ in other columns the one that comes
first as JSON stays in near-dedup.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import common, decontamination, language, line_dedup, order_minhash, packing
from feedloom.operators import scale

# A document is in a language if this share of its words or more is.
LEAST_SHARE = 0.3
BROADCAST_IDS = 1_000_000


def _named(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Documents with the names of their rows, the rows (_id, _key) under the same
    columns, and these: no column that documents already have."""
    keys = [common.free_name(x, docs.columns) for x in ("_id", "_key")]
    named = docs.withColumns(dict(zip(keys, (F.col("doc_id"), common.text_key(F.col("text"))))))
    return named, rows.select("_id", "_key").toDF(*keys), keys


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, with too little of any, or too unlikely in theirs, go."""
    model = language.learned(docs.select("doc_id", "text", "lang"), judging=True)
    out = tuple(common.free_name(x, docs.columns) for x in ("_language", "_share", "_plausible"))
    told = language.identify(docs, model, out=out)
    named, share, plausible = map(F.col, out)
    stays = (named != language.UNKNOWN) & (share >= LEAST_SHARE) & plausible
    return told.where(stays).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines seen before go, and with them documents of which no line is left."""
    out = tuple(common.free_name(x, docs.columns) for x in ("_n_lines", "_n_exact", "_n_edited"))
    told = line_dedup.without_seen_lines(docs, out=out)
    left = (F.col(out[1]) + F.col(out[2]) == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    kept = told.where(left).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the document of the least id stays."""
    told = order_minhash.near_duplicates(docs).select(F.col("doc_id").alias("_id"), "_key", "_first")
    told = scale.stage(told)
    firsts = told.where("_first").select("_id", "_key")
    named, wanted, keys = _named(docs, firsts.distinct())
    kept = common.join_on(named, wanted, keys, "inner")
    if not firsts.groupBy("_id", "_key").count().where("count > 1").isEmpty():
        row = F.struct(*docs.columns)
        kept = kept.groupBy(*keys).agg(F.min_by(row, F.to_json(row)).alias(keys[0] + "row")).select(f"{keys[0]}row.*")
    return kept.select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go."""
    told = decontamination.contamination(docs, common.read_table(spark, sf_dir, "benchmark"))
    bad = scale.stage(told.where(decontamination.contaminated()).select(F.col("doc_id").alias("_id"), "_key").distinct())
    if common.small_rows(bad, BROADCAST_IDS):
        bad = F.broadcast(bad)
    named, bad, keys = _named(docs, bad)
    return common.join_on(named, bad, keys, "left_anti").select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens; a row per piece of a document."""
    made = packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return made.withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", lines),
    ("minhash_dedup", near_copies),
    ("decontamination", benchmark_free),
    ("packing", sequences),
]

# A mixture found by expectation-maximisation has no SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread."""
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scale.stage(docs)
    return docs
