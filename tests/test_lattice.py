import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from feedloom.operators import lattice

SCHEMA = "kind STRING, day INT, part LONG, user LONG, value LONG"
DIMS = ["kind", "day", "part"]


def expected(rows, sets):
    groups, sets = defaultdict(list), {frozenset(part) for part in sets}
    for row in rows:
        for part in sets:
            key = tuple(x if d in part else None for d, x in zip(DIMS, row))
            groups[key, sum(1 << k for k, d in enumerate(reversed(DIMS)) if d not in part)].append(row)
    return {
        (*key, id, len(held), len({r[3] for r in held if r[3] is not None}), sum(r[4] for r in held)) for (key, id), held in groups.items()
    }


def rows():
    own = random.Random(2)
    users = [None, 0, -1, -40_000, 32_767, 32_768, 32_769, 10**15, *range(100, 160)]
    return [(own.choice(["hot", "hot", "a", None]), own.randrange(3), own.choice([1, 2, None]), own.choice(users), own.randrange(9)) for _ in range(2_000)]


@pytest.mark.parametrize("sets", [lattice.cube(DIMS), lattice.rollup(DIMS), [("kind",), ("day", "part")], [()], [("part", "kind"), ("kind", "part")]])
def test_equals_each_set_by_itself(spark, sets):
    data = rows()
    got = lattice.grouping_sets(spark.createDataFrame(data, SCHEMA), DIMS, sets, "user", {"total": F.col("value")})
    assert got.columns == [*DIMS, "grouping_id", "n", "distinct", "total"]
    told = [tuple(r) for r in got.collect()]
    assert len(told) == len(set(told)) and set(told) == expected(data, sets)


def test_empty_table_and_unknown_dimension(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert lattice.grouping_sets(none, DIMS, lattice.cube(DIMS), "user").count() == 0
    with pytest.raises(ValueError):
        lattice.grouping_sets(none, DIMS, [("user",)], "user")


def test_rows_are_not_repeated_for_each_set(spark):
    got = lattice.grouping_sets(spark.createDataFrame(rows(), SCHEMA), DIMS, lattice.cube(DIMS), "user")
    plan = got._jdf.queryExecution().toString()
    assert "Expand" not in plan and "Join" not in plan
