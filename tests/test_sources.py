import json

import pytest

from feedloom import schemas
from feedloom.sources import tables


def test_stories_with_absent_fields(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"id": 1, "title": "t", "url": "u", "feed_pos": 1}\n{"id": 2, "feed_pos": 2}\n')
    got = [tuple(r) for r in tables.load_stories(spark, str(tmp_path)).orderBy("id").collect()]
    assert got == [(1, "t", "u", 1), (2, None, None, 2)]


def test_feed_of_ids_and_items(spark, tmp_path):
    (tmp_path / "ids.json").write_text(json.dumps([30, 10, 20, 40]))
    items = [{"id": 10, "title": "ten", "url": "u10"}, {"id": 20, "title": "twenty"}, {"id": 40, "title": "late"}]
    (tmp_path / "items.json").write_text("\n".join(map(json.dumps, items)))
    feed = tables.load_feed(spark, str(tmp_path / "ids.json"), str(tmp_path / "items.json"), 3)
    got = [tuple(r) for r in feed.orderBy("feed_pos").collect()]
    assert got == [(30, None, None, 1), (10, "ten", "u10", 2), (20, "twenty", None, 3)]

    table = spark.createDataFrame([(30, 1), (10, 2), (20, 3), (40, 4)], schemas.FEED_IDS)
    tables.write_table(table, str(tmp_path / "ids"), "parquet")
    feed = tables.load_feed(spark, str(tmp_path / "ids"), str(tmp_path / "items.json"), 3, ids_fmt="parquet")
    assert [tuple(r) for r in feed.orderBy("feed_pos").collect()] == got


RECORDS = [
    ("m", 1, 1, 'say "hi", then\ngo', ["a", 'b"c', "d,e"], 0.25, None),
    ("", 1, 2, None, [], 1e-7, 3.0),
    ("é", 2, 1, "back\\slash", None, 12345678.9, 0.0),
]


@pytest.mark.parametrize("fmt", ["json", "parquet", "orc"])
def test_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame(RECORDS, schemas.RECORDS)
    path = str(tmp_path / "out")
    tables.write_table(df, path, fmt)
    tables.write_table(df, path, fmt)
    back = tables.read_table(spark, path, fmt, schemas.RECORDS)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_json_writes_nulls(spark, tmp_path):
    tables.write_table(spark.createDataFrame(RECORDS, schemas.RECORDS), str(tmp_path / "out"), "json")
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    assert all(set(line) == set(schemas.RECORDS.names) for line in lines)


def test_csv_flattens_lists(spark, tmp_path):
    path = str(tmp_path / "out")
    tables.write_table(spark.createDataFrame(RECORDS, schemas.RECORDS), path, "csv")
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text.startswith(",".join(schemas.RECORDS.names))
    flat = schemas._table(**{f.name: schemas.TEXT if f.name == "output" else f.dataType for f in schemas.RECORDS})
    back = {r.model: r for r in tables.read_table(spark, path, "csv", flat).collect()}
    assert json.loads(back["m"].output) == ["a", 'b"c', "d,e"]
    assert back["m"].question == 'say "hi", then\ngo' and back["m"].loading_time is None
    assert back["é"].question == "back\\slash" and back["é"].inference_time == 12345678.9
