"""WARC archives: written with one gzip member per record, read sequentially.

Writing. Equal payloads are found by their SHA-1: the digest groups are combined
map-side and only (digest, largest id) of repeated ones meet the pages again, as
a broadcast when they were counted to be few, else in a shuffle whose hot digest
the adaptive skew join splits. Each task turns its pages into members; the files
go through Spark's own committed writer, so a lost executor leaves no half
archive. The text writer puts its line separator after every member; it is a
gzip member of an empty string, which is valid anywhere in such a file.

Reading. A file is read front to back: slices of it are fed to zlib, members end
where zlib says so, and a record is framed by its own Content-Length. The digest
of every payload is computed again and compared.

Edge cases: a null payload is empty; a null url is an empty target. Pages of
equal payload and no id at all, and copies of the row with the largest id, are
responses. An empty table gives no records. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import common
from feedloom.operators import scale

# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000002ff03000000000000000000")
DATE = b"2020-01-01T00:00:00Z"

FEED_BYTES = 1 << 16
GZIP_LEVEL = 6
# Repeated digests that may be broadcast: 50 bytes each.
BROADCAST_DIGESTS = 200_000

READ_SCHEMA = (
    "record_id bigint, record_type string, target_uri string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, digest_ok boolean"
)


def _head(lines: list[tuple[bytes, bytes]]) -> bytes:
    return VERSION + b"\r\n" + b"".join(k + b": " + v + b"\r\n" for k, v in lines) + b"\r\n"


def _clean(text: str | None) -> bytes:
    """A header value: line breaks would end it, so they are percent-encoded."""
    return (text or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A").encode()


def _unclean(value: bytes) -> str:
    return value.decode().replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _page(record_id: int | None) -> bytes:
    return b"<urn:page:" + (b"" if record_id is None else str(record_id).encode()) + b">"


def _page_id(value: bytes | None) -> int | None:
    digits = (value or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(digits) if digits else None


def record(record_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit has the HTTP head of the page and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        (b"WARC-Type", b"response" if refers_to is None else b"revisit"),
        (b"WARC-Record-ID", _page(record_id)),
        (b"WARC-Date", DATE),
        (b"WARC-Target-URI", _clean(url)),
        (b"WARC-Payload-Digest", b"sha1:" + base64.b32encode(digest)),
        (b"Content-Type", b"application/http; msgtype=response"),
    ]
    if refers_to is not None:
        lines += [(b"WARC-Profile", PROFILE), (b"WARC-Refers-To", _page(refers_to))]
    return _head([*lines, (b"Content-Length", b"%d" % len(block))]) + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, path: str, id: str, url: str, payload: str, min_bytes: int = 0) -> None:
    """Write a record per page to gzipped archives under ``path``.

    Of pages with equal payloads of at least ``min_bytes`` bytes, that with the
    largest id is the response and the others revisit it.
    """
    rows = pages.select(
        F.col(id).cast("bigint").alias("_id"),
        F.col(url).cast("string").alias("_url"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("_payload"),
    ).withColumn("_digest", F.unhex(F.sha1("_payload")))
    repeated = (
        rows.where(F.length("_payload") >= min_bytes)
        .groupBy("_digest")
        .agg(F.max("_id").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .select("_digest", "_first")
    )
    repeated = scale.stage(repeated)
    if common.small_rows(repeated, BROADCAST_DIGESTS):
        repeated = F.broadcast(repeated)
    first = F.when(F.length("_payload") >= min_bytes, F.col("_first"))
    told = rows.join(repeated, "_digest", "left").withColumn("_refers", F.when(~first.eqNullSafe(F.col("_id")), first))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            for part in common.sliced(batch, 256):
                made = zip(*[part.column(c).to_pylist() for c in ("_id", "_url", "_payload", "_digest", "_refers")])
                yield {"member": [member(record(*row)) for row in made]}

    columns = ["_id", "_url", "_payload", "_digest", "_refers"]
    made = common.arrow_map(told.select(*columns), members, "member binary")
    (
        made.select(F.col("member").cast("string").alias("value"))
        .write.option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .text(path)
    )


def inflated(data: memoryview) -> Iterator[bytes]:
    """Contents of the gzip members of a file, in pieces, front to back."""
    at, unpacker, rest, begun = 0, zlib.decompressobj(31), b"", False
    while at < len(data) or rest:
        piece = rest or bytes(data[at : at + FEED_BYTES])
        at += 0 if rest else len(piece)
        out, begun = unpacker.decompress(piece), True
        rest = unpacker.unused_data
        if out:
            yield out
        if unpacker.eof:
            unpacker, begun = zlib.decompressobj(31), False
    if begun:
        raise ValueError("the last member is cut off")


class Stream:
    """Bytes of an iterator of pieces: up to a mark, or so many."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held += piece
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What precedes the mark, which is dropped; None at the end."""
        seen = 0
        while (at := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                if self.held:
                    raise ValueError("a record is cut off")
                return None
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError("a record is cut off")
            out = bytes(self.held[:n])
            del self.held[: len(out)]
            n -= len(out)
            yield out


def records(data: memoryview, keep_payload: bool = False) -> Iterator[dict]:
    """Records of one archive in order, their payloads digested again."""
    stream = Stream(inflated(data))
    while (head := stream.until(b"\r\n\r\n")) is not None:
        version, *lines = head.split(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a record: {version[:20]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines)}
        http, kept, size, digest = b"", [], 0, hashlib.sha1()
        in_head = fields.get(b"content-type", b"").startswith(b"application/http")
        for piece in stream.take(int(fields[b"content-length"])):
            if in_head:
                http += piece
                if (at := http.find(b"\r\n\r\n")) < 0:
                    continue
                http, piece, in_head = http[:at], http[at + 4 :], False
            size += len(piece)
            digest.update(piece)
            if keep_payload:
                kept.append(piece)
        if b"".join(stream.take(4)) != b"\r\n\r\n":
            raise ValueError("a record is longer than its Content-Length")
        kind, told = fields[b"warc-type"].decode(), fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:")
        revisit = kind == "revisit"
        full = dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:] if b": " in x).get(b"Content-Length", b"%d" % size)
        yield {
            "record_id": _page_id(fields.get(b"warc-record-id")),
            "record_type": kind,
            "target_uri": _unclean(fields.get(b"warc-target-uri", b"")),
            "refers_to": _page_id(fields.get(b"warc-refers-to")),
            "payload_bytes": int(full) if revisit else size,
            "payload_digest": told.decode(),
            "digest_ok": None if revisit else base64.b32encode(digest.digest()) == told,
        } | ({"payload": b"".join(kept)} if keep_payload else {})


def read_archives(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """The records of all archives under ``path``, a row each.

    ``digest_ok`` tells whether the payload has its announced digest, null for
    revisits, whose payload is elsewhere. A task holds one archive at a time.
    """
    schema = READ_SCHEMA + (", payload binary" if keep_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            for content in batch.column("content"):
                out, held = {n: [] for n in names}, 0
                for row in records(memoryview(content.as_buffer()), keep_payload):
                    for n in names:
                        out[n].append(row[n])
                    held += 200 + (len(row["payload"]) if keep_payload else 0)
                    if held > common.BATCH_BYTES:
                        yield out
                        out, held = {n: [] for n in names}, 0
                yield out

    files = spark.read.format("binaryFile").load(path).select("content")
    return common.arrow_map(files, read, schema)


def archived(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back.

    Fails if a payload does not have the digest it was written with.
    """
    path = scale.new_path(pages.sparkSession, "warc")
    write_archives(pages, path, id, url, payload, min_bytes)
    read = read_archives(pages.sparkSession, path)
    message = F.concat(F.lit("a payload was damaged: record "), F.coalesce(F.col("record_id").cast("string"), F.lit("without id")))
    return read.where(F.when(F.coalesce("digest_ok", F.lit(True)), True).otherwise(F.raise_error(message).cast("boolean")))
