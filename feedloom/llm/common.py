"""What the operators share: table access, row identity, Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows that a task hands on at once, in bytes of their values.
BATCH_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """64 bits of a text; null and empty texts are told apart.

    Together with an id it names a row: repeated rows share the name, and every
    operator gives equal rows equal results.
    """
    return F.xxhash64(text.isNull(), text)


def same(left: Column, right: Column) -> Column:
    """Equality under which nulls are equal; still an equi-join key."""
    return left.eqNullSafe(right)


def free_name(name: str, *taken: list[str]) -> str:
    """A column name that no given list has, in any case of letters."""
    used = {column.lower() for columns in taken for column in columns}
    while name.lower() in used:
        name += "_"
    return name


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join in which null keys match each other; keeps the keys of the left."""
    other = {k: free_name(f"_r_{k}", left.columns, right.columns) for k in keys}
    renamed = right.select(*[F.col(k).alias(other[k]) for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(other[k])) for k in keys]
    return left.join(renamed, on, how).drop(*other.values())


def small_rows(df: DataFrame, max_rows: int) -> bool:
    """Whether a written table of narrow rows may be broadcast: it is counted first."""
    return df.count() <= max_rows


def arrow_map(
    df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, list]]], schema: str
) -> DataFrame:
    """Run a generator of column lists over the partitions, by Arrow batches."""
    target = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in rows(batches):
            made = [columns[f.name] for f in target]
            made = [x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(made, target)]
            yield pa.RecordBatch.from_arrays(made, schema=target)

    return df.mapInArrow(run, schema)


def pa_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def sliced(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that what is made of it stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
