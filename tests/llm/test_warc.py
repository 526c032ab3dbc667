import base64
import hashlib
import os

import oracle
import pytest

from feedloom.llm import warc
from feedloom.operators import scale


def test_pages_as_in_sql(spark):
    oracle.assert_equal(spark, "op3_warc")


def test_copies_nulls_and_clashing_columns(spark):
    rows = [(1, "a", "x", 0), (2, "b\r\nc%", "x", 0), (5, None, "x", 0), (3, "d", None, 0), (4, "e", "", 0), (7, "f", "é" * 200_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, member int")
    got = {r.record_id: r for r in warc.archived(pages).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {
        1: ("revisit", 5), 2: ("revisit", 5), 5: ("response", None),
        3: ("revisit", 4), 4: ("response", None), 7: ("response", None),
    }
    assert got[7].payload_bytes == 400_000 and got[1].payload_bytes == 1 and got[3].payload_bytes == 0
    assert got[2].target_uri == "b\r\nc%"
    assert got[1].payload_digest == base64.b32encode(hashlib.sha1(b"x").digest()).decode()
    assert got[5].digest_ok and got[1].digest_ok is None


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "a", "x"), (None, "a", "x"), (9, "a", "y"), (9, "a", "y"), (1, "b", "y")]
    got = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(r.record_id), r.record_type, r.refers_to) for r in got) == [
        ("1", "revisit", 9), ("9", "response", None), ("9", "response", None), ("None", "response", None), ("None", "response", None)
    ]


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "a", "x"), (2, "a", "x")], "page_id long, url string, html string")
    assert {r.record_type for r in warc.archived(pages, min_bytes=2).collect()} == {"response"}


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(pages).count() == 0


def test_payloads_come_back(spark):
    pages = spark.createDataFrame([(1, "a", "x\r\n\r\ny")], "page_id long, url string, html string")
    path = scale.new_path(spark, "warc")
    warc.write_archives(pages, path, "page_id", "url", "html")
    assert [bytes(r.payload) for r in warc.read_archives(spark, path, keep_payload=True).collect()] == [b"x\r\n\r\ny"]


def test_damage_fails_the_query(spark, monkeypatch):
    def damaged(pages, path, *_):
        folder = path.removeprefix("file:")
        os.makedirs(folder)
        data = warc.record(1, "u", b"abc" * 1000, hashlib.sha1(b"abc" * 1000).digest(), None)
        with open(f"{folder}/part.txt", "wb") as file:
            file.write(warc.member(data.replace(b"abcabc", b"abcabd", 1)))

    monkeypatch.setattr(warc, "write_archives", damaged)
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    with pytest.raises(Exception, match="a payload was damaged: record 1"):
        warc.archived(pages).select("record_id").collect()


def test_damage_is_seen():
    data = warc.record(1, "u", b"abc" * 1000, hashlib.sha1(b"abc" * 1000).digest(), None)
    assert [r["digest_ok"] for r in warc.records(memoryview(warc.member(data)))] == [True]
    assert [r["digest_ok"] for r in warc.records(memoryview(warc.member(data.replace(b"abcabc", b"abcabd", 1))))] == [False]
    for broken in (warc.member(data)[:-9], warc.member(data[:-4])):
        with pytest.raises(ValueError):
            list(warc.records(memoryview(broken)))
