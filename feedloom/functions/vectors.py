"""Vector expressions.

Two forms of vector are used:

* sparse counts, ``ARRAY<STRUCT<bucket INT, weight BIGINT>>`` sorted by bucket,
  made from text by hashing its tokens. All arithmetic up to the final division
  is on integers, so scores do not depend on the order of evaluation;
* dense floats, ``ARRAY<FLOAT>``, as a trained model gives. Arithmetic is in
  DOUBLE.

Arguments are column names or SQL expressions. ``let`` evaluates a value once
per row: written inline, it would be evaluated at each mention, and inside a
lambda once more per element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 384
TOKEN = r"([\p{L}\p{N}]+)"


def let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``value`` bound to ``name``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _tokens(text: str) -> str:
    """Lower-case runs of letters and digits."""
    return f"regexp_extract_all(lower({text}), r'{TOKEN}', 1)"


def _bucket(token: str, dim: int) -> str:
    """Bucket of a token: first 16 bits of its MD5, modulo ``dim``."""
    return f"pmod(cast(conv(substr(md5({token}), 1, 4), 16, 10) AS INT), {dim})"


def token_counts(text: str, dim: int = DIM) -> Column:
    """Sparse counts of the hashed tokens of a text, without a shuffle.

    The buckets are sorted inside the row; each run of equal buckets becomes
    one entry whose weight is the length of the run.
    """
    run_ends = (
        "filter(sequence(1, greatest(size(buckets), 1)), i -> "
        "i <= size(buckets) AND coalesce(get(buckets, i) <> get(buckets, i - 1), true))"
    )
    entries = (
        "transform(ends, (run_end, k) -> named_struct("
        "'bucket', get(buckets, run_end - 1), "
        "'weight', cast(run_end - coalesce(get(ends, k - 1), 0) AS BIGINT)))"
    )
    buckets = f"sort_array(transform({_tokens(text)}, token -> {_bucket('token', dim)}))"
    counts = let("buckets", buckets, let("ends", run_ends, entries))
    return F.expr(f"CASE WHEN ({text}) IS NOT NULL THEN {counts} END")


def _dense_counts(sparse: str, dim: int) -> str:
    """Zeros up to each entry, the entry, and zeros after the last one."""

    def zeros(n: str) -> str:
        return f"array_repeat(0L, {n})"

    def bucket_before(k: str) -> str:
        return f"coalesce(get(entries, {k} - 1).bucket, -1)"

    runs = f"transform(entries, (entry, k) -> concat({zeros(f'entry.bucket - {bucket_before("k")} - 1')}, array(entry.weight)))"
    tail = zeros(f"{dim} - 1 - {bucket_before('size(entries)')}")
    return let("entries", sparse, f"concat(flatten({runs}), {tail})")


def dense_counts(sparse: str, dim: int = DIM) -> Column:
    """Sparse counts as an array of ``dim`` integers."""
    return F.expr(_dense_counts(sparse, dim))


def _sparse_norm(sparse: str) -> str:
    return f"sqrt(cast(aggregate({sparse}, 0L, (total, entry) -> total + entry.weight * entry.weight) AS DOUBLE))"


def sparse_norm(sparse: str) -> Column:
    """Euclidean length of sparse counts."""
    return F.expr(_sparse_norm(sparse))


def _sparse_dot(sparse: str, dense: str) -> str:
    return f"aggregate({sparse}, 0L, (total, entry) -> total + entry.weight * get({dense}, entry.bucket))"


def _dense_dot(a: str, b: str) -> str:
    products = f"zip_with({a}, {b}, (x, y) -> cast(x AS DOUBLE) * cast(y AS DOUBLE))"
    return f"aggregate({products}, 0D, (total, product) -> total + product)"


def _dense_norm(a: str) -> str:
    return f"sqrt(aggregate({a}, 0D, (total, x) -> total + cast(x AS DOUBLE) * cast(x AS DOUBLE)))"


def dense_norm(a: str) -> Column:
    return F.expr(_dense_norm(a))


def _cosine(dot: str, norm_a: str, norm_b: str) -> str:
    return f"coalesce(try_divide(cast({dot} AS DOUBLE), {norm_a} * {norm_b}), 0D)"


def measured_cosine(item: str, item_norm: str, query: str, query_norm: str, sparse: bool) -> Column:
    """Cosine of vectors whose lengths are known; 0 when a length is 0 or missing.

    Of sparse vectors the query has been densified.
    """
    dot = _sparse_dot(item, query) if sparse else _dense_dot(item, query)
    return F.expr(_cosine(dot, item_norm, query_norm))


def cosine(a: str, b: str) -> Column:
    """Cosine of two dense vectors; 0 when one has no length."""
    return F.expr(_cosine(_dense_dot(a, b), _dense_norm(a), _dense_norm(b)))


def sparse_cosine(a: str, b: str, dim: int = DIM) -> Column:
    """Cosine of two sparse count vectors; 0 when one is empty."""
    dot = let("dense", _dense_counts(b, dim), _sparse_dot(a, "dense"))
    return F.expr(_cosine(dot, _sparse_norm(a), _sparse_norm(b)))
