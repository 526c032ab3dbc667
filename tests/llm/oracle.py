"""Compare a query with its SQL over the same tables."""

import math

import duckdb
from conftest import SF_DIR

from feedloom.llm import queries

TABLES = "documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def assert_equal(spark, name, sf_dir=SF_DIR):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    frame = queries.QUERIES[name](spark, sf_dir)
    told = db.execute(queries.ORACLES[name])
    names = [d[0] for d in told.description]
    expected = rows_of(names, told.fetchall())
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    assert sorted(names) == sorted(frame.columns)
    assert len(expected) == len(got) > 0
    assert [(g, e) for g, e in zip(got, expected) if g != e][:1] == []
