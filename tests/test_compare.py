from collections import Counter

from feedloom.operators import compare

SCHEMA = "lang STRING, id LONG, size LONG, rank LONG"
OLD = [("a", 1, 10, 1), ("a", 2, 9, 2), ("a", 3, 8, 3), (None, 4, None, 1), (None, None, 5, 2), ("b", 5, None, None), ("c", 6, 1, 1), ("c", 6, 2, 1)]
NEW = [("a", 1, 10, 1), ("a", 3, 8, 2), ("a", 7, 7, 3), (None, 4, None, 1), (None, None, 6, 2), ("b", 5, None, 1), ("c", 6, 1, 1)]


def test_changes_by_key(spark):
    got = compare.keyed_changes(spark.createDataFrame(OLD, SCHEMA), spark.createDataFrame(NEW, SCHEMA), ["lang", "id"], "rank")
    told = {(r.lang, r.id): (r.change, r.moved, r.n_old, r.n_new) for r in got.collect()}
    assert told == {
        ("a", 1): ("same", 0, 1, 1), ("a", 2): ("removed", None, 1, 0), ("a", 3): ("moved", 1, 1, 1), ("a", 7): ("added", None, 0, 1),
        (None, 4): ("same", 0, 1, 1), (None, None): ("changed", 0, 1, 1), ("b", 5): ("moved", None, 1, 1), ("c", 6): ("same", 0, 2, 1),
    }
    row = got.where("id = 2").first()
    assert row.new is None and tuple(row.old) == (9, 2)
    plain = compare.keyed_changes(spark.createDataFrame(OLD, SCHEMA), spark.createDataFrame(NEW, SCHEMA), ["lang", "id"])
    assert "moved" not in plain.columns and plain.where("id = 3").first().change == "changed"


def test_bags(spark):
    old, new = [("a", None), ("a", None), ("b", 1), (None, None), (None, 2)], [("a", None), ("b", 1), (None, None), ("c", 3), ("c", 3)]
    got = compare.bag_changes(spark.createDataFrame(old, "x STRING, y INT"), spark.createDataFrame(new, "x STRING, y INT"))
    lost, won = Counter(old), Counter(new)
    assert {tuple(r) for r in got.collect()} == {(*k, lost[k], won[k]) for k in lost.keys() | won.keys() if lost[k] != won[k]}


def test_empty_versions_and_one_exchange(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame(OLD, SCHEMA)
    assert compare.keyed_changes(none, none, ["id"]).count() == 0 and compare.bag_changes(some, some).count() == 0
    assert {r.change for r in compare.keyed_changes(none, some, ["id", "lang"]).collect()} == {"added"}
    plan = compare.keyed_changes(some, none, ["lang", "id"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
