"""Building blocks that keep joins and rankings spread over the cluster.

* ``keyed_join`` broadcasts the right side only after counting that it is
  small; otherwise it shuffles, and the rows of the heaviest keys are salted so
  that no task receives more than its share of a hot key;
* ``ordered_positions`` numbers the rows of a total order, as a whole or per
  group, without putting the order or a group into one task;
* ``stage`` cuts the lineage in shared storage, so that lost executors cost a
  re-read and values that depend on row placement are fixed once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side of at most this many rows and bytes, both counted, is broadcast.
BROADCAST_ROWS = 5_000
BROADCAST_BYTES = 64 << 20

# Keys whose joined rows come to more than HEAVY_BYTES are salted, one slice per
# HEAVY_BYTES and at most one per shuffle partition. A caller whose rows are wider
# than ROW_BYTES, both sides together, says so. The list of such keys has at most
# one row per HEAVY_BYTES of the join; it is broadcast if it was counted to fit.
HEAVY_BYTES = 256 << 20
ROW_BYTES = 256
HEAVY_ROWS = HEAVY_BYTES // ROW_BYTES

# A table of fewer splits than this may be dealt anew over idle cores.
SPREAD_SPLITS = 64

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row below


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read: ``spark.checkpoint.dir``.

    The library never chooses one; ``session.with_shared_folder`` does for a
    session of one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return folder


def new_path(spark: SparkSession, what: str) -> str:
    """An unused path in the shared folder."""
    application = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/feedloom-{application}/{what}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder now and return the written table.

    Tables lie in a folder of the application; ``remove_stages`` deletes it when
    no result is read any more.
    """
    path = new_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_stages(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(new_path(spark, "any")).getParent()
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _bytes_of(field: T.StructField) -> Column:
    """Width of a value in memory: texts by their length, lists by their elements."""
    name = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        width = F.octet_length(name)
    elif isinstance(field.dataType, T.ArrayType):
        element = field.dataType.elementType
        if isinstance(element, (T.StringType, T.BinaryType)):
            width = F.aggregate(name, F.lit(0), lambda total, x: total + F.coalesce(F.octet_length(x), F.lit(0)) + 16)
        else:
            width = F.size(name) * (16 if isinstance(element, T.StructType) else 8)
    else:
        width = F.lit(16)
    return F.coalesce(width, F.lit(0)).cast("bigint") + 8


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table has at most so many rows and bytes; reads no more rows than needed."""
    widths = [_bytes_of(field) for field in df.schema.fields]
    width = sum(widths[1:], widths[0]) if widths else F.lit(8)
    rows, held = df.select(width.alias("_width")).limit(max_rows + 1).agg(F.count("*"), F.sum("_width")).first()
    return rows <= max_rows and (held or 0) <= max_bytes


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Give every core a part of a scanned table of few input splits; larger
    tables, of SPREAD_SPLITS splits or more, are never shuffled for this.

    For plain scans: asking a plan with shuffles for its partitions runs them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *by) if df.rdd.getNumPartitions() < min(cores, SPREAD_SPLITS) else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def heavy_keys(df: DataFrame, keys: list[str], min_rows: int = HEAVY_ROWS) -> DataFrame:
    """The keys of more than ``min_rows`` rows with the number of slices each
    needs; counted with map-side combine."""
    slices = F.least(F.ceil(F.col("_rows") / min_rows), F.lit(shuffle_partitions(df.sparkSession)))
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("_rows"))
        .where(F.col("_rows") > min_rows)
        .select(*keys, slices.cast("bigint").alias("_slices"))
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread_by: list[str],
    how: str = "inner",
    min_rows: int = HEAVY_ROWS,
    row_bytes: int = ROW_BYTES,
) -> DataFrame:
    """Join on ``keys`` with the left rows of heavy keys dealt over slices.

    ``spread_by`` are left columns that tell the rows of one key apart. ``how``
    may be inner, left, left_semi or left_anti: each left row meets all its
    right rows in exactly one slice, so the result is that of the plain join.
    Rows without a key match nothing and are dealt over all partitions.
    """
    heavy = stage(heavy_keys(left, keys, max(1, min_rows * ROW_BYTES // row_bytes)))
    if fits(heavy, max_rows=1_000_000):
        heavy = F.broadcast(heavy)
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    keyless = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    slices_of_row = F.when(keyless, F.lit(shuffle_partitions(left.sparkSession))).otherwise(F.coalesce("_slices", one))
    sliced_left = (
        left.join(heavy, keys, "left")
        .withColumn("_slice", F.pmod(F.xxhash64(*spread_by), slices_of_row))
        .drop("_slices")
    )
    sliced_right = (
        right.join(heavy, keys, "left")
        .withColumn("_slice", F.explode(F.sequence(none, F.coalesce("_slices", one) - 1)))
        .drop("_slices")
    )
    return sliced_left.join(sliced_right, [*keys, "_slice"], how).drop("_slice")


def keyed_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread_by: list[str],
    how: str = "inner",
    broadcast_rows: int = BROADCAST_ROWS,
    min_rows: int = HEAVY_ROWS,
    small: bool | None = None,
    row_bytes: int = ROW_BYTES,
) -> DataFrame:
    """Equi-join of a large left side with hot keys: broadcast when the right
    side is counted small, salted shuffle otherwise. Callers that have counted
    pass the outcome as ``small``."""
    if fits(right, broadcast_rows) if small is None else small:
        return left.join(F.broadcast(right), keys, how)
    return salted_join(left, right, keys, spread_by, how, min_rows, row_bytes)


def ordered_positions(
    df: DataFrame, order: list[Column], by: list[str] | None = None, out: str = "position", few_groups: bool | None = None
) -> DataFrame:
    """1-based position of every row in ``order``, within the group ``by``.

    The range sort deals rows to tasks by the whole sort key, so hot groups and
    equal scores are split as long as ``order`` ends in a unique column. The
    row's place in the sort is then fixed in the staged table; positions follow
    from it and from the row counts per task (and group), a table of at most
    tasks + groups rows. The sort reads ``df`` twice, once to sample its ranges.
    ``few_groups`` tells that the groups were counted and fit a broadcast.
    """
    by = by or []
    placed = stage(df.orderBy(*by, *order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", _ROW_BITS))
    runs = placed.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        *by, "_part", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift")
    )
    # Without groups there is one row per task; with groups their number decides.
    few = not by or (fits(offsets) if few_groups is None else few_groups)
    if few:
        offsets = F.broadcast(offsets)
    return (
        placed.join(offsets, [*by, "_part"])
        .withColumn(out, F.col("_at") + F.col("_shift"))
        .drop("_at", "_part", "_shift")
    )
