import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from feedloom.operators import generation, parsing


def python_slice(text, close):
    start = text.find("{")
    end = (text.find("}") if close == "first" else text.rfind("}")) + 1
    return text[start:end]


def slices(spark, texts, close):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, response STRING")
    return [r.slice for r in parsing.slice_json(rows, close).orderBy("i").collect()]


EDGES = ["", "{", "}", "}{", "{}", "a{b}c}d", "no } before {", "ends with }", "{a", "x}", "{{}}", "}{}", "é{ü}", "}}"]


@pytest.mark.parametrize("close", ["first", "last"])
def test_slices_are_pythons(spark, close):
    assert slices(spark, EDGES, close) == [python_slice(t, close) for t in EDGES]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet="{}ab é", max_size=12), min_size=50, max_size=100))
def test_slices_of_random_texts(spark, texts):
    for close in ("first", "last"):
        assert slices(spark, texts, close) == [python_slice(t, close) for t in texts]


# Slice and its queries; None is a failure.
CASES = [
    ('{"queries": ["A","a","B"]}', ["a", "b"]),
    ('{"queries": []}', []),
    ('{"queries": ["a"], "queries": ["b"]}', ["b"]),
    ('{"queries": ["é","É"]}', ["é"]),
    ('{"n": {"x": [1, null]}, "queries": ["a"]}', ["a"]),
    ('{"big": 123456789012345678901234567890123456789012345, "e": 1e999, "queries": ["a"]}', ["a"]),
    (' { "queries" : [ "a b" , "\\u0041\\n" ] } ', ["a\n", "a b"]),
    ("{'queries': ['a']}", None),
    ('{"queries": [1,"a"]}', None),
    ('{"queries": [true]}', None),
    ('{"queries": [["a"]]}', None),
    ('{"queries": [{"a": 1}]}', None),
    ('{"queries": null}', None),
    ('{"queries": {}}', None),
    ('{"q": []}', None),
    ("", None),
    ("}", None),
    ('{"queries": [null]}', None),
    ('{"queries": ["a",null]}', None),
    ('{"queries": ["a"]} x }', None),
    ('{"queries": ["a"]} {"queries": ["b"]}', None),
    ('{"queries": ["a"]},{"queries": ["b"]}', None),
    ('{"queries": ["a"],}', None),
    ('{"queries": ["a",]}', None),
    ('{"queries": "abc"}', None),
    ('{queries: ["a"]}', None),
    ('{"queries": ["a"]', None),
]


def parsed(spark, **how):
    rows = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(CASES)], "i INT, slice STRING")
    return parsing.parse_queries(rows, **how).orderBy("i").collect()


def test_strict_parse(spark):
    for row, (text, expected) in zip(parsed(spark, on_fail="null"), CASES):
        assert (row.output, row.parsed) == (expected, expected is not None), text


def test_cases_agree_with_python_json():
    for text, expected in CASES:
        try:
            queries = sorted({q.lower() for q in json.loads(text)["queries"]})
        except Exception:
            queries = None
        assert queries == expected or text == '{"queries": "abc"}' or text == '{"queries": {}}', text


def test_marker_policy(spark):
    for row, (text, expected) in zip(parsed(spark, on_fail="marker"), CASES):
        assert row.output == (["Failed to parse response: " + text] if expected is None else expected)


def test_empty_policy_keeps_any_object(spark):
    for row, (text, _) in zip(parsed(spark, on_fail="empty", normalise=False), CASES):
        try:
            found = json.loads(text)
        except ValueError:
            assert (row.output, row.parsed) == ([], False), text
        else:
            assert row.parsed, text
            if isinstance(found.get("queries"), list) and all(isinstance(q, str) for q in found["queries"]):
                assert row.output == found["queries"], text


def test_explode_numbers_from_one(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None), (4, ["c", None])], "i INT, output ARRAY<STRING>")
    got = {(r.i, r.version, r.query) for r in parsing.explode_outputs(rows).collect()}
    assert got == {(1, 1, "a"), (1, 2, "b"), (4, 1, "c"), (4, 2, None)}


def test_few_shot_goldens(spark):
    """The worked examples inside the few-shot prompt parse to their queries."""
    from feedloom.fixed_values import FEWSHOT_TEMPLATE

    answers = FEWSHOT_TEMPLATE.split("User: ")[1:4]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i INT, response STRING")
    got = parsing.parse_queries(parsing.slice_json(rows, "last"), on_fail="null").orderBy("i").collect()
    assert [len(r.output) for r in got] == [2, 1, 5]
    assert got[0].output == ["milutin milankovic lifespan", "nikola tesla lifespan"]


def test_echo_is_removed_before_slicing(spark):
    prompt = 'Answer like {"queries": []}'
    rows = spark.createDataFrame(
        [(1, prompt, prompt + ' \n{"queries": ["x"]}\n'), (2, prompt, ' {"queries": ["y"]} '), (3, prompt, None)],
        "i INT, prompt STRING, response STRING",
    )
    got = generation.strip_echo(rows).orderBy("i").collect()
    assert [r.response for r in got] == ['{"queries": ["x"]}', ' {"queries": ["y"]} ', None]
