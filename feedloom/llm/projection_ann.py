"""Nearest neighbours by low-dimensional stable projections.

Vectors are projected on DIMS random Gaussian directions. For two points at
distance D the squared distance of their projections is D^2 times a chi-square
variable of DIMS degrees, whatever their dimension. Each block of rows has a
kd-tree over its projections. A query walks the tree from the nearest cell on and
measures what it meets; it stops when a point that is nearer than its k-th so far
would have to be projected so far off that this has a chance below 1 - CONFIDENCE.

Blocks are written to the shared folder as the index. Every query meets every
block: queries go, in packs, to each block's partition, and a task streams them
past the one block it holds. The k best of each block are merged per query.

Equal vectors of a block are one point with its k + 1 least ids, which is all
that a result can show of them; so ties go to the smaller id and a vector that a
third of the rows share costs no more than one.

Edge cases: rows without an id, and vectors that are null, empty, zero or hold a
null or a non-finite component, take no part. Only vectors of equal length are
compared. Candidates with the query's own id are left out; repeated rows count
once. If there are fewer candidates than k, all are returned.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm import common
from feedloom.operators import scale

DIMS = 10
CONFIDENCE = 0.99
BLOCK_ROWS = 1 << 15
PACK_ROWS = 256
LEAF_ROWS = 48
SEED = 20_251

INDEX = "part bigint, block bigint, dim int, ids binary, vectors binary"


def chi_square(x: float, degrees: int) -> float:
    """Probability that a chi-square variable of an even degree is at most x."""
    term, total = 1.0, 1.0
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def quantile(confidence: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < confidence else (low, middle)
    return high


def directions(dim: int, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(SEED + dim).standard_normal((dim, dims))


class Tree:
    """kd-tree over projected points: cells of at most LEAF_ROWS points."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.low, self.high, self.range, self.child = [], [], [], []
        self._build(points, 0, len(points))

    def _build(self, points: np.ndarray, begin: int, end: int) -> int:
        node, own = len(self.low), points[self.order[begin:end]]
        low, high = own.min(0), own.max(0)
        self.low.append(low)
        self.high.append(high)
        self.range.append((begin, end))
        self.child.append(())
        if end - begin > LEAF_ROWS and (high > low).any():
            middle = (end - begin) // 2
            part = np.argpartition(own[:, int(np.argmax(high - low))], middle)
            self.order[begin:end] = self.order[begin:end][part]
            self.child[node] = (self._build(points, begin, begin + middle), self._build(points, begin + middle, end))
        return node

    def distance(self, node: int, q: np.ndarray) -> float:
        """Squared distance of the cell."""
        off = np.maximum(self.low[node] - q, 0) + np.maximum(q - self.high[node], 0)
        return float(off @ off)


class Block:
    """Points of a block: different vectors, each with its least ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.lexsort([ids, *vectors.T[::-1]])
        ids, vectors = ids[order], vectors[order]
        new = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(1)])
        self.vectors = vectors[new]
        bounds = np.append(np.flatnonzero(new), len(ids))
        self.ids = [np.unique(ids[a:b])[: k + 1] for a, b in zip(bounds[:-1], bounds[1:])]
        self.directions = directions(vectors.shape[1])
        self.projected = self.vectors @ self.directions
        self.tree, self.k = Tree(self.projected), k

    def nearest(self, own: int, query: np.ndarray, limit: float) -> list[tuple[float, int]]:
        """The k nearest found: (distance, id), nearest first, ties by id."""
        q, tree, enough = query @ self.directions, self.tree, self.k + 1
        # Distance and least id, negated, the farthest first; then the point.
        best: list[tuple[float, int, int]] = []
        waiting = [(tree.distance(0, q), 0)]
        while waiting:
            away, node = heapq.heappop(waiting)
            reach = -best[0][0] if len(best) == enough else math.inf
            if away > limit * reach:
                break
            if tree.child[node]:
                for child in tree.child[node]:
                    heapq.heappush(waiting, (tree.distance(child, q), child))
                continue
            begin, end = tree.range[node]
            points = tree.order[begin:end]
            if reach < math.inf:
                points = points[((self.projected[points] - q) ** 2).sum(1) <= limit * reach]
            squares = ((self.vectors[points] - query) ** 2).sum(1)
            for square, point in zip(squares.tolist(), points.tolist()):
                if len(best) == enough and square > -best[0][0]:
                    continue
                entry = (-square, -next((int(i) for i in self.ids[point] if i != own), own), point)
                if len(best) < enough:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        found = [(math.sqrt(-s), int(i)) for s, _, point in best for i in self.ids[point] if i != own]
        return sorted(found)[: self.k]


def usable(vector: Column) -> Column:
    """Not null, empty or zero, every component a finite number."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def packed(rows: DataFrame, most: int) -> DataFrame:
    """Rows (_id, _vector) as blocks of at most ``most`` vectors of one length."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def block(dim: int) -> dict[str, list]:
            ids, vectors = zip(*held.pop(dim))
            return {
                "part": [part], "block": [made], "dim": [dim],
                "ids": [np.array(ids, "<i8").tobytes()], "vectors": [np.array(vectors, "<f8").tobytes()],
            }

        for batch in batches:
            for part_of in common.sliced(batch, 4096):
                for key, vector in zip(part_of.column("_id").to_pylist(), part_of.column("_vector")):
                    values = vector.values.to_numpy(zero_copy_only=False)
                    rows = held.setdefault(len(values), [])
                    rows.append((key, values))
                    if len(rows) == most:
                        yield block(len(values))
                        made += 1
        for dim in sorted(held):
            yield block(dim)
            made += 1

    return common.arrow_map(rows, pack, INDEX)


def build_index(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """All usable vectors in blocks, written to the shared folder and numbered."""
    blocks = scale.stage(packed(_rows(vectors, id, vector), BLOCK_ROWS))
    # One narrow row per block of BLOCK_ROWS vectors.
    numbers = blocks.select("part", "block", (F.row_number().over(Window.orderBy("part", "block")) - 1).alias("slot"))
    return blocks.join(F.broadcast(numbers), ["part", "block"])


def _rows(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    rows = vectors.select(F.col(id).cast("bigint").alias("_id"), F.col(vector).cast("array<double>").alias("_vector"))
    return rows.where(F.col("_id").isNotNull() & usable(F.col("_vector")))


def nearest(index: DataFrame, queries: DataFrame, id: str, vector: str, k: int = 10, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query vector."""
    slots = index.count()
    packs = packed(_rows(queries, id, vector), PACK_ROWS).select(
        F.explode(F.sequence(F.lit(0), F.lit(max(slots, 1) - 1))).alias("slot"), F.lit(1).alias("kind"), "dim", "ids", "vectors"
    )
    both = index.select("slot", F.lit(0).alias("kind"), "dim", "ids", "vectors").unionByName(packs)
    dealt = both.repartition(max(slots, 1), "slot").sortWithinPartitions("slot", "kind")
    limit = quantile(confidence, DIMS)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        slot, block = None, None
        for batch in batches:
            for at, kind, dim, ids, vectors in zip(*[batch.column(c) for c in ("slot", "kind", "dim", "ids", "vectors")]):
                ids = np.frombuffer(ids.as_buffer(), "<i8")
                vectors = np.frombuffer(vectors.as_buffer(), "<f8").reshape(len(ids), dim.as_py())
                if kind.as_py() == 0:
                    slot, block = at.as_py(), Block(ids, vectors, k)
                elif slot == at.as_py() and block.vectors.shape[1] == vectors.shape[1]:
                    out: dict[str, list] = {"query_id": [], "_query": [], "vec_id": [], "score": []}
                    for own, query in zip(ids.tolist(), vectors):
                        found = block.nearest(own, query, limit)
                        out["query_id"] += [own] * len(found)
                        out["_query"] += [_name(query)] * len(found)
                        out["vec_id"] += [i for _, i in found]
                        out["score"] += [s for s, _ in found]
                    yield out

    found = common.arrow_map(dealt, search, "query_id bigint, _query bigint, vec_id bigint, score double")
    # At most k rows per query and block, of which each task keeps k.
    order = Window.partitionBy("query_id", "_query").orderBy("score", "vec_id")
    return (
        found.distinct()
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _name(vector: np.ndarray) -> int:
    """Tells different vectors of one query id apart."""
    import xxhash

    return xxhash.xxh64_intdigest(vector.tobytes()) - (1 << 63)
