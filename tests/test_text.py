from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from feedloom.functions import text as tx
from feedloom.operators import corpus


def apply(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [r.x for r in rows.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


class TextOnly(HTMLParser):
    """Plain-Python reference for well-formed pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.silent = [], 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in ("script", "style", "template")

    def handle_endtag(self, tag):
        self.silent -= tag in ("script", "style", "template")

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)


def python_text(html):
    parser = TextOnly()
    parser.feed(html)
    parser.close()
    return "".join(parser.text)


WELL_FORMED = [
    "<p>one</p><p>two</p>",
    "<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style></head><body>x\n<b>y</b></body></html>",
    '<script>var t="</p>"; if (a<b) {}</script>after',
    "<SCRIPT type='x'>no</SCRIPT >yes<template><p>no</p></template>",
    "<!-- <script> -->kept<!-- </script> -->",
    "<script>a<!-- b</script>c",
    '<a title="a>b" href=x?a=b>link</a>',
    "<p title='it>s'>quoted</p><p data-x=\"1\" checked>",
    "1 < 2 and 3 > 2",
    "a &amp;lt; b &amp;amp; &quot;q&quot; &copy;&middot;&nbsp;|",
    "&#39;&#x27;&#8212;&eacute;&hearts;&zzznoname; &",
    "&#128512; &#0; &#150;",
    "plain",
    "",
]


def test_html_text_matches_html_parser(spark):
    assert apply(spark, WELL_FORMED, tx.html_text) == [python_text(h) for h in WELL_FORMED]


def test_html_text_of_broken_pages(spark):
    pages = ["a<script>never closed", "a<!-- never closed", "<ruby>x<rt>y</rt></ruby>z", None, "<p title=it's>x</p>"]
    assert apply(spark, pages, tx.html_text) == ["a", "a", "xz", None, "x"]


def test_html_text_does_not_backtrack_or_overflow(spark):
    pages = ["<a " + "x=1 " * 100_000, "<a " + 'x="1" ' * 100_000 + ">t", "<" * 100_000, "<script>" + "<" * 300_000]
    got = apply(spark, pages, tx.html_text)
    assert got[1:] == ["t", "<" * 100_000, ""]
    assert got[0] == pages[0]


def test_html_text_of_all_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for row in corpus.extract_text(pages).collect():
        assert row.text == python_text(row.html)


def test_strip_is_pythons(spark):
    edges = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    values = [e + "a b" + e for e in edges] + ["".join(edges), "a\n", "\n\na", "a", "", "​a​"]
    assert apply(spark, values, tx.strip) == [v.strip() for v in values]


@pytest.mark.parametrize("size,kept", [(199, False), (200, False), (201, True)])
def test_long_lines_boundary(spark, size, kept):
    line = "é" * size
    assert apply(spark, [line], tx.long_lines) == [line if kept else ""]


def test_long_lines_split_on_newline_only(spark):
    a, b = "a" * 201, "b" * 201
    values = [f"{a}\n{b}", f"{a}\r{b}", f"{a} {b}", f"\n\n{a}\nshort\n", "", None]
    expected = [None if v is None else " ".join(x for x in v.split("\n") if len(x) > 200) for v in values]
    assert apply(spark, values, tx.long_lines) == expected


def test_body_is_capped_before_the_title(spark):
    rows = spark.createDataFrame(
        [("t", "x" * 200_005), ("t", None), (None, "x"), ("t", "short")], "title STRING, text STRING"
    )
    bodies = corpus.story_bodies(rows).select("body").collect()
    assert sorted(len(r.body) for r in bodies) == [2, 2, 200_002]
    assert corpus.untitled(rows).count() == 1


def test_fetch_outcomes(spark):
    rows = spark.createDataFrame(
        [
            ("u", 200, None, "ok"),
            (None, 200, None, "x"),
            ("u", 404, None, "x"),
            ("u", None, "timeout", "x"),
            ("u", 200, "late", "x"),
            ("u", 200, None, ""),
        ],
        "url STRING, status INT, error STRING, text STRING",
    )
    assert [r.text for r in corpus.resolve_fetch(rows).collect()] == ["ok", None, None, None, None, None]


CUSTOM_ELEMENTS = [
    "a<style-guide>kept</style-guide>b",
    "a<script-loader>rest of page",
    "a<template-card>kept</template-card>b",
    "a<rt-x>kept</rt-x>b<stylesheet>c",
    "a<style/>b</style>c",
]


def test_custom_elements_are_ordinary(spark):
    class Silent(TextOnly):
        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs)

    def python(html):
        parser = Silent()
        parser.feed(html)
        parser.close()
        return "".join(parser.text)

    assert apply(spark, CUSTOM_ELEMENTS[:4], tx.html_text) == [python(h) for h in CUSTOM_ELEMENTS[:4]]
    assert apply(spark, CUSTOM_ELEMENTS[4:], tx.html_text) == ["ac"]


def test_nested_templates_end_at_their_own_tag(spark):
    pages = ["a<template>x<template>y</template>z</template>b", "a<template>x<b>y<template>z</template></b></template>b<i>c</i>", "a<template>x<template>y"]
    assert apply(spark, pages, tx.html_text) == ["ab", "abc", "a"]


def test_templates_are_followed_as_deep_as_stated(spark):
    def page(depth):
        return "a" + "<template>x<p>" * depth + "</p></template>y" * depth + "b"

    pages = [page(9), page(50), page(tx.NESTED), "a" + "<template>x" * tx.NESTED, page(tx.NESTED + 1)]
    # One that opens deeper ends with the next closing tag, so the last ends one too early.
    assert apply(spark, pages, tx.html_text) == ["ayb", "ayb", "ayb", "a", "ayyb"]
