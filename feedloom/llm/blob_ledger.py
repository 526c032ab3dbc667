"""Secrets in versions of files, each distinct text scanned once per rule version.

A version is a row with a path and a text; its blob is the SHA-256 of the text in
UTF-8. The ledger is a folder of batches, one written by each scan: per blob the
rule versions it was scanned for, as ``rule@version``, and what they found. A scan
reads which pairs of blob and rule version are there, looks for the rest only, and
adds a batch; findings are joined back to all versions of a blob, under whatever
paths. Changed rules get a new version, and then only they run again.

Copies are combined before they are shuffled, so that a text is scanned once
however many rows have it, and no task collects the rows of a blob. If few blobs
are new (counted), only their texts leave the scan; otherwise every distinct text
is shuffled once. Findings meet the rows of a hot blob in a salted join.

A batch counts only when Spark's committer has marked it whole: a scan that lost
its driver leaves nothing that is read, and lost executors repeat their tasks.
Two scans at once may both look at a blob; their equal findings count once.

Spans are start and end (exclusive) of the whole match, in code points.

Edge cases: a null text is empty. Repeated rows, and rows of equal path and
different text, are versions of their own. An empty table adds an empty batch.
The columns of the versions are kept under any names, those of the result excepted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import common
from feedloom.operators import scale

SCHEMA = "blob binary, pairs array<string>, findings array<struct<pair:string,start:int,end:int>>"
FOUND = "array<struct<start:int,nth:int,kind:string,end:int>>"

# Blobs to be scanned, or with findings, that may be broadcast; their bytes are counted too.
BROADCAST_BLOBS = 200_000
# Versions of one blob that may meet its findings in one task.
HOT_ROWS = scale.HEAVY_ROWS


@dataclass(frozen=True)
class Rule:
    """A pattern; of its leftmost non-overlapping matches those count whose group
    ``measured`` has ``least`` characters or more."""

    name: str
    version: int
    pattern: str
    least: int = 1
    measured: int = 0

    @property
    def pair(self) -> str:
        return f"{self.name}@{self.version}"


def _any_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# The base rules.
_NAMES = _any_case("(password|passwd|secret|token|api_?key)")
ASSIGN = Rule("assign", 1, _NAMES + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2)
ACCESS = Rule("access", 1, "AKIA[A-Z0-9]+", 18)
HEX = Rule("hex", 1, "[0-9a-f]+", 16)
BASE = (ASSIGN, ACCESS, HEX)

PRIVATE_KEY = Rule("private_key", 1, r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----")
WEB_TOKEN = Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
RULES = (*BASE, PRIVATE_KEY, WEB_TOKEN)


def blob_of(text: Column) -> Column:
    """Content address of a text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _searched(rule: Rule) -> re.Pattern:
    """The pattern, with the bound inside where that leaves the matches as they
    are: a class repeated at the end, measured from the start of the match."""
    repeated = re.fullmatch(r"([A-Z]*)(\[[^\]]+\])\+", rule.pattern)
    if repeated and rule.measured == 0 and rule.least > len(repeated[1]) and _inside(repeated[1], repeated[2]):
        return re.compile(f"{repeated[1]}{repeated[2]}{{{rule.least - len(repeated[1])},}}")
    return re.compile(rule.pattern)


def _inside(letters: str, repeated: str) -> bool:
    """A match that is too short then has no longer one inside."""
    return all(re.fullmatch(repeated, c) for c in letters)


def spans(text: str, rule: Rule) -> list[tuple[int, int]]:
    """Start and end of a rule's matches."""
    found = _searched(rule).finditer(text)
    return [m.span() for m in found if m.end(rule.measured) - m.start(rule.measured) >= rule.least]


def batches(spark: SparkSession, ledger: str) -> DataFrame:
    """All rows of the ledger's finished batches."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(f"{ledger}/batch-*/_SUCCESS")
    found = pattern.getFileSystem(conf).globStatus(pattern)
    paths = [f.getPath().getParent().toString() for f in found or []]
    return spark.read.schema(SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], SCHEMA)


def unscanned(versions: DataFrame, ledger: DataFrame, text: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, todo): the distinct texts and the rule versions they lack."""
    wanted = F.array(*[F.lit(r.pair) for r in rules])
    seen = ledger.select("blob", F.explode("pairs").alias("pair")).groupBy("blob").agg(F.collect_set("pair").alias("seen"))
    blobs = versions.select(blob_of(F.col(f"`{text}`")).alias("blob")).distinct()
    todo = F.coalesce(F.array_except(wanted, "seen"), wanted)
    return blobs.join(seen, "blob", "left").select("blob", todo.alias("todo")).where(F.size("todo") > 0)


def scan(versions: DataFrame, ledger: str, text: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Look for the pairs of blob and rule version the ledger lacks, and add them."""
    spark = versions.sparkSession
    todo = scale.stage(unscanned(versions, batches(spark, ledger), text, rules))
    said = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts = versions.select(blob_of(F.col(f"`{text}`")).alias("blob"), said.alias("text"))
    once = lambda df: df.groupBy("blob").agg(F.first("text").alias("text"))
    if scale.fits(todo, BROADCAST_BLOBS):
        texts = once(texts.join(F.broadcast(todo.select("blob")), "blob", "left_semi")).join(F.broadcast(todo), "blob")
    else:
        texts = once(texts).join(todo, "blob")
    by_pair = {r.pair: r for r in rules}

    def look(parts: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in parts:
            for part in common.sliced(batch):
                blobs, texts, pairs = (part.column(c).to_pylist() for c in ("blob", "text", "todo"))
                found = [
                    [{"pair": p, "start": a, "end": b} for p in todo for a, b in spans(said, by_pair[p])]
                    for said, todo in zip(texts, pairs)
                ]
                yield {"blob": blobs, "pairs": pairs, "findings": found}

    made = common.arrow_map(texts.select("blob", "text", "todo"), look, SCHEMA)
    made.write.parquet(f"{ledger}/batch-{scale.new_path(spark, 'x').rsplit('-', 1)[1]}")


def report(versions: DataFrame, ledger: str, text: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The versions without their text, with their ``blob`` and its ``findings``
    (start, nth rule, kind, end) by start and order of the rules."""
    spark = versions.sparkSession
    order = F.create_map(*[F.lit(x) for n, r in enumerate(rules) for x in (r.pair, n)])
    names = F.array(*[F.lit(r.name) for r in rules])
    one = F.struct(
        F.col("f.start").alias("start"), order[F.col("f.pair")].alias("nth"),
        names[order[F.col("f.pair")]].alias("kind"), F.col("f.end").alias("end"),
    )
    # A blob has as many findings as its text has room for.
    found = (
        batches(spark, ledger).select("blob", F.explode("findings").alias("f"))
        .where(F.col("f.pair").isin([r.pair for r in rules]))
        .groupBy("blob").agg(F.array_sort(F.collect_set(one)).alias("findings"))
    )
    found = scale.stage(found)
    others = [F.col(f"`{c}`") for c in versions.columns if c not in (text, "blob", "findings")]
    rest = versions.select(F.struct(F.lit(0).alias("_none"), *others).alias("_row"), blob_of(F.col(f"`{text}`")).alias("blob"))
    few = scale.fits(found, BROADCAST_BLOBS)
    # The row travels as one value, so that its names clash with none.
    told = scale.keyed_join(rest, found, ["blob"], ["_row"], "left", small=few, min_rows=HOT_ROWS)
    return told.select("_row.*", "blob", F.coalesce("findings", F.array().cast(FOUND)).alias("findings")).drop("_none")


def listed(findings: Column, kinds: list[str] | None = None) -> Column:
    """``kind:start:end`` of findings, joined by commas."""
    some = findings if kinds is None else F.filter(findings, lambda f: f["kind"].isin(kinds))
    return F.array_join(F.transform(some, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def counted(findings: Column, kind: str) -> Column:
    return F.size(F.filter(findings, lambda f: f["kind"] == kind)).cast("bigint")
