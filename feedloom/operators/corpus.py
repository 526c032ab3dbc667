"""From fetched pages to story bodies. Row-wise, without Python; only
``drop_repeated_lines`` looks across rows and shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.fixed_values import LONG_LINE_CHARS, MAX_TEXT_CHARS
from feedloom.functions import text as tx
from feedloom.functions.text import content_key
from feedloom.operators import scale


def extract_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Add the text of each page."""
    return pages.withColumn(out, tx.html_text(F.col(html)))


def resolve_fetch(
    pages: DataFrame,
    url: str = "url",
    status: str = "status",
    error: str = "error",
    text: str = "text",
) -> DataFrame:
    """Keep the text of usable fetches only: no url, a status other than 200,
    an error or an empty text all give null."""
    unusable = (
        F.col(url).isNull()
        | ~F.col(status).eqNullSafe(200)
        | F.col(error).isNotNull()
        | (F.col(text) == "")
    )
    return pages.withColumn(text, F.when(~unusable, F.col(text)))


def keep_long_lines(df: DataFrame, text: str = "text", min_len: int = LONG_LINE_CHARS) -> DataFrame:
    """Drop lines of ``min_len`` characters or fewer; join the rest by a space."""
    return df.withColumn(text, tx.long_lines(F.col(text), min_len))


def cap_text(df: DataFrame, text: str = "text", n: int = MAX_TEXT_CHARS) -> DataFrame:
    """Cut the text to ``n`` characters."""
    return df.withColumn(text, F.substring(F.col(text), 1, n))


def compose_body(df: DataFrame, title: str = "title", text: str = "text", out: str = "body") -> DataFrame:
    """Title, newline, text; a missing text counts as empty. Rows without a
    title have no body: see ``titled`` and ``untitled``."""
    return df.withColumn(out, F.concat(F.col(title), F.lit("\n"), F.coalesce(F.col(text), F.lit(""))))


def titled(df: DataFrame, title: str = "title") -> DataFrame:
    """Rows that can have a body."""
    return df.where(F.col(title).isNotNull())


def untitled(df: DataFrame, title: str = "title") -> DataFrame:
    """The reject table: rows without a title."""
    return df.where(F.col(title).isNull())


def story_bodies(df: DataFrame) -> DataFrame:
    """The whole text job on rows with ``title`` and resolved ``text``."""
    return titled(df).transform(keep_long_lines).transform(cap_text).transform(compose_body)


def drop_repeated_lines(df: DataFrame, id: str, text: str = "text", least: int = 3) -> DataFrame:
    """Texts without the lines that ``least`` or more rows have.

    Per row each different line counts once, by its key; counting combines
    map-side. Only the keys of repeated lines meet the rows again: they are
    broadcast if counted to be few, else hot lines are salted. ``id`` names a row.
    """
    lines = df.select(id, F.posexplode(F.split(text, "\n")).alias("_no", "_line"))
    keyed = scale.stage(lines.select(id, "_no", content_key(F.col("_line")).alias("_line_key")))
    repeated = (
        keyed.select(id, "_line_key").distinct().groupBy("_line_key").count().where(F.col("count") >= least).select("_line_key")
    )
    found = scale.keyed_join(keyed, scale.stage(repeated), ["_line_key"], [id, "_no"], how="left_semi")
    gone = found.groupBy(id).agg(F.collect_set("_no").alias("_gone"))
    kept = F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("_gone", i))
    cut = F.when(F.col("_gone").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(text))
    return df.join(gone, id, "left").withColumn(text, cut).select(df.columns)
