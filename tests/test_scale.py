import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from feedloom.operators import ranking, scale


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one key, some have none."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 97)
    return spark.range(3_000).select("id", key.cast("int").alias("k")).cache()


@pytest.fixture(scope="module")
def side(spark):
    return spark.range(0, 60).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("path", ["broadcast", "salted"])
def test_keyed_join_equals_plain_join(spark, hot, side, how, path):
    plain = hot.join(side, ["k"], how)
    sizes = {} if path == "broadcast" else {"broadcast_rows": 0, "min_rows": 100}
    joined = scale.keyed_join(hot, side, ["k"], ["id"], how, **sizes).select(plain.columns)
    assert rows(joined) == rows(plain)


def test_slices_grow_with_the_key(spark, hot):
    parts = scale.shuffle_partitions(spark)
    slices = {r.k: r["_slices"] for r in scale.heavy_keys(hot, ["k"], 500).collect()}
    assert slices == {0: min(3, parts)}
    assert max(r["_slices"] for r in scale.heavy_keys(hot, ["k"], 10).collect()) == parts


def test_hot_key_is_dealt_over_tasks(spark, hot, side):
    heavy = scale.heavy_keys(hot, ["k"], 250)
    dealt = hot.join(heavy, "k").groupBy(F.pmod(F.xxhash64("id"), F.col("_slices")).alias("slice")).count().collect()
    assert len(dealt) == scale.shuffle_partitions(spark)
    assert max(r["count"] for r in dealt) < 1.3 * 1_000 / len(dealt)


def test_fits_reads_up_to_the_limit(spark):
    assert scale.fits(spark.range(10), 10)
    assert not scale.fits(spark.range(11), 10)
    assert scale.fits(spark.range(0), 0)


def test_positions_equal_plain_window(spark):
    df = spark.range(5_000).select("id", F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(7)).alias("score"))
    df = scale.stage(df)
    ranked = scale.ordered_positions(df, [F.desc("score"), F.asc("id")])
    plain = df.withColumn("plain", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("id"))))
    assert ranked.join(plain, "id").where(F.col("position") != F.col("plain")).count() == 0
    assert ranked.count() == 5_000


@pytest.mark.parametrize("few", [True, False])
def test_positions_in_hot_groups(spark, few):
    group = F.when(F.col("id") % 3 != 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string")))
    df = scale.stage(spark.range(4_000).select("id", group.alias("g"), (F.col("id") * 7919 % 1_000).alias("v")))
    ranked = scale.ordered_positions(df, [F.col("v"), F.col("id")], by=["g"], few_groups=few)
    plain = df.withColumn("plain", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    assert ranked.join(plain, "id").where(F.col("position") == F.col("plain")).count() == 4_000


def test_positions_of_nothing(spark):
    assert scale.ordered_positions(spark.range(0), [F.col("id")]).count() == 0


def test_corpus_rank_equals_request_rank(spark):
    df = spark.range(1, 401).select(
        F.lit(1).alias("profile_id"), F.col("id").alias("original_rank"), (F.col("id") * 37 % 11 / 11).alias("score")
    )
    one = ranking.re_rank(df).select("original_rank", "rank", "change")
    other = ranking.re_rank_corpus(df).select("original_rank", "rank", "change")
    assert rows(one) == rows(other)
    assert sorted(r["rank"] for r in one.collect()) == list(range(1, 401))
    assert one.agg(F.sum("change")).first()[0] == 0


def test_shared_dir_is_the_sessions(spark):
    assert scale.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_broadcast_is_decided_by_bytes_too(spark):
    wide = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("t"), F.array_repeat(F.lit(1.0), 100).alias("v"))
    assert scale.fits(wide, 10) and not scale.fits(wide, 10, max_bytes=15_000)


def test_every_heavy_key_is_salted(spark):
    rows = spark.range(40_000).select((F.col("id") % 20_000).alias("k"), "id")
    assert scale.heavy_keys(rows, ["k"], 1).count() == 20_000


def test_stages_are_removed(spark, tmp_path):
    import os

    scale.stage(spark.range(3))
    folder = os.path.dirname(scale.new_path(spark, "x"))
    assert os.path.isdir(folder)
    scale.remove_stages(spark)
    assert not os.path.exists(folder)
