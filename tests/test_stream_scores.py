import math
import statistics

from conftest import SF_DIR
from pyspark.sql import functions as F

from feedloom.operators import scale
from feedloom.operators.embedding import embed
from feedloom.plans import catalog
from feedloom.streaming import scores, windows

STORIES = "page_id LONG, url STRING, seen TIMESTAMP, lang STRING, text STRING, batch INT"
EVENTS = "k STRING, ts TIMESTAMP, value DOUBLE, batch INT"


def at(second):
    return F.timestamp_seconds(F.lit(1_700_000_000) + second)


def stories(spark, rows):
    made = spark.createDataFrame([(n, u, s, k, t, b) for n, (u, s, k, t, b) in enumerate(rows)], STORIES.replace("seen TIMESTAMP", "seen LONG"))
    return made.withColumn("seen", at(F.col("seen")))


ROWS = [
    ("u1", 0, "en", "apple pear", 0), ("u2", 5, "de", "birne", 0), (None, 6, "en", "apple", 0), ("u3", 7, None, "apple", 0),
    ("u1", 0, "en", "told again", 1), ("u4", 100, "en", "", 1), ("u5", 101, "en", None, 1),
    ("u6", 8, "en", "too late", 2), ("u2", 102, "de", "as new", 2), ("u7", 103, "de", "apfel", 2),
]


def run(spark, rows, embedder=None):
    path = scale.new_path(spark, "test")
    profiles = scale.stage(embed(spark.createDataFrame([("p", "en", "apple"), ("q", "de", "birne apfel")], "profile_id STRING, lang STRING, text STRING")))

    def runs(arriving):
        found = scores.score_arriving(arriving, profiles, "lang", "seen", "10 seconds", embedder=embedder)
        late = scores.set_aside(arriving, F.col("seen"), "seen", "10 seconds", f"{path}/late", f"{path}/progress-late")
        return [scores.append(found, f"{path}/scores", f"{path}/progress"), late]

    def read():
        found = spark.read.parquet(f"{path}/scores").collect()
        late = scores.late_rows(f"{path}/late", rows.drop("batch")).collect()
        return {r.page_id: round(r.score, 6) for r in found}, len(found), sorted(r.page_id for r in late)

    scores.replay(rows, 3, f"{path}/in", runs)
    return read, lambda: [q.awaitTermination() for q in runs(spark.readStream.schema(rows.drop("batch").schema).parquet(f"{path}/in"))]


def test_each_url_is_scored_once_and_late_rows_are_kept(spark):
    read, again = run(spark, stories(spark, ROWS))
    wanted = {0: round(1 / math.sqrt(2), 6), 1: round(1 / math.sqrt(2), 6), 5: 0.0, 6: 0.0, 8: 0.0, 9: round(1 / math.sqrt(2), 6)}
    found, n, late = read()
    assert (found, n, late) == (wanted, 6, [7])
    again()  # nothing new: a restart from the checkpoint adds nothing
    assert read() == (wanted, 6, [7])


def test_urls_seen_longer_ago_than_the_delay_count_as_new(spark):
    rows = [("u", 0, "en", "apple", 0), ("v", 1000, "en", "apple", 1), ("u", 1001, "en", "apple", 2)]
    read, _ = run(spark, stories(spark, rows))
    assert read()[0] == {0: 1.0, 1: 1.0, 2: 1.0}


def test_pages_are_matched_by_key_without_a_cross_join(spark):
    arriving = spark.readStream.format("rate").load()
    arriving = arriving.select(F.lit("u").alias("url"), F.col("timestamp").alias("seen"), F.lit("en").alias("lang"), F.lit("t").alias("text"))
    profiles = scale.stage(embed(spark.createDataFrame([("p", "en", "apple")], "profile_id STRING, lang STRING, text STRING")))
    found = scores.score_arriving(arriving, profiles, "lang", "seen", "10 seconds")
    plan = found._jdf.queryExecution().toString()
    assert "DeduplicateWithinWatermark" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_window_statistics_merge(spark):
    values = [(f"k{n % 3}", n // 7, float(n * n % 101)) for n in range(200)]
    parts = spark.createDataFrame(values, "k STRING, part LONG, value DOUBLE").groupBy("k", "part").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("m2"),
        F.min("value").alias("least"), F.max("value").alias("most"))
    for r in windows.merged(parts, ["k"]).collect():
        own = [v for k, _, v in values if k == r.k]
        assert (r.n, r.least, r.most) == (len(own), min(own), max(own))
        assert math.isclose(r.mean, statistics.fmean(own)) and math.isclose(r.m2, statistics.pvariance(own) * len(own))


def test_windows_without_rows_and_null_keys(spark):
    path = scale.new_path(spark, "test")
    rows = spark.createDataFrame([(None, 0, 1.0, 0), (None, 30, 3.0, 0), ("a", 10, None, 0), ("a", 100_000, 2.0, 1)], EVENTS.replace("ts TIMESTAMP", "ts LONG"))
    rows = rows.withColumn("ts", at(F.col("ts")))

    def runs(arriving):
        return [scores.append(windows.tumbling(arriving, ["k"], "value", "ts", "1 hour", "1 minute"), f"{path}/out", f"{path}/progress")]

    scores.replay(rows, 2, f"{path}/in", runs)
    found = {r.k: (r.n, r.mean, r.m2) for r in spark.read.parquet(f"{path}/out").collect()}
    assert found == {None: (2, 2.0, 2.0), "a": (0, None, None)}


def test_state_of_windows_is_partial_before_the_shuffle(spark):
    arriving = spark.readStream.format("rate").load().select(F.col("timestamp").alias("ts"), F.col("value").cast("double").alias("value"), F.lit("k").alias("k"))
    plan = windows.tumbling(arriving, ["k"], "value", "ts", "1 hour", "1 minute")._jdf.queryExecution().toString()
    assert "EventTimeWatermark" in plan and "var_pop" in plan


def test_queries_are_registered_with_sql():
    names = [n for n in catalog.QUERIES if n.startswith("stream_")]
    assert len(names) == 6 and all(n in catalog.ORACLES for n in names) and SF_DIR
