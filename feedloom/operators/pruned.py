"""The exact top candidates of a whole corpus, without scoring all of it.

Vectors are put on the unit sphere, where the cosine c and the distance d are one
measure: d^2 = 2 - 2c. Pivots from a bounded sample make cells; every vector is in
the cell of its nearest pivot, with its distance from it. By the triangle inequality
no vector of a cell is nearer to a query than the query's distance to the pivot less
the radius of the cell, nor than the least distance of the cell less the query's.

Vectors lie in blocks, ordered by cell. First each query takes the cells nearest to
it and learns a bound: the score of its k-th candidate there. Then it visits the
other cells that the bound does not rule out. What is skipped cannot be among the
best, so the result is that of scoring everything.

A task meets one block with packs of queries. It scores a cell of the block with all
queries that visit it as one matrix product, and scores again, term by term, those
that come within SLACK of a query's best: only these leave it, at most k for each
query and cell.

Edge cases: null, zero and null-holding vectors take no part, nor do null ids. A
vector that is not finite has the score NaN with all others, above any number. Vectors
of different lengths do not meet. Repeated rows are candidates each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from feedloom.functions import vectors as vx
from feedloom.functions.binding import bind
from feedloom.operators import scale

# Vectors from which pivots are chosen, by the hash of their ids; pivots in a query's first round.
PIVOTS, FIRST_CELLS = 256, 4
# Added to every reach, and taken off every bound, for the rounding of matrix products.
REACH_SLACK, SLACK = 1e-5, 1e-9
# Values of the vectors in a block and in a pack of queries, and scores at once, 8 bytes each.
BLOCK_VALUES, PACK_VALUES, SCORES = 1 << 19, 1 << 17, 1 << 20


def _unit(rows: DataFrame, id: str, vec: str, name: str) -> DataFrame:
    """(name, name_vec): vectors of length 1; those without a length are left out."""
    # The length is bound, else it is measured again for each component.
    unit = bind(vx.dense_norm("_v"), lambda norm: F.when(norm > 0, F.transform("_v", lambda x: x.cast("double") / norm)))
    told = rows.select(F.col(id).alias(name), F.col(vec).alias("_v")).select(name, unit.alias(f"{name}_vec"))
    return told.where(F.col(name).isNotNull() & F.col(f"{name}_vec").isNotNull())


def _chosen(rows: DataFrame, most: int) -> Broadcast:
    """Different vectors of a bounded sample, spread by hash, by their length: the
    pivots decide about speed, not about results."""
    held: dict[int, list] = {}
    for (vector,) in rows.orderBy(F.xxhash64("item"), "item").limit(most).select("item_vec").collect():
        held.setdefault(len(vector), []).append(vector)
    pivots = {n: np.unique(np.array(vectors), axis=0) for n, vectors in held.items()}
    pivots = {n: x[np.isfinite(x).all(1)] for n, x in pivots.items()}
    return rows.sparkSession.sparkContext.broadcast({n: x for n, x in pivots.items() if len(x)})


def _kind(rows: DataFrame, name: str) -> str:
    return rows.schema[name].dataType.simpleString()


def _known(pivots: Broadcast, vectors: np.ndarray) -> np.ndarray:
    """The pivots of the length of these vectors."""
    n = vectors.shape[1]
    return pivots.value.get(n, np.zeros((0, n)))


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (vectors @ pivots.T), 0))


def _by_length(column: pa.ListArray, rows: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of the vectors of one length, few at a time."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        for begin in range(0, len(at), rows):
            some = at[begin : begin + rows]
            values = column.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False)
            yield some, values.reshape(len(some), n)


def _placed(rows: DataFrame, pivots: Broadcast) -> DataFrame:
    """The items with ``dim``, the length of the vector, its ``cell`` and how ``far`` it is
    from the pivot. After the cells of the pivots comes one for vectors without distances."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cells = np.zeros((2, batch.num_rows), np.int32)
            far = np.zeros(batch.num_rows)
            for at, vectors in _by_length(batch.column("item_vec")):
                known = _known(pivots, vectors)
                dims[at], cells[at] = vectors.shape[1], len(known)
                if len(known):
                    finite = np.isfinite(vectors).all(1)
                    away = _distances(vectors[finite], known)
                    cells[at[finite]], far[at[finite]] = away.argmin(1), away.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (dims, cells, far))], [*batch.schema.names, "dim", "cell", "far"])

    return rows.mapInArrow(place, f"item {_kind(rows, 'item')}, item_vec array<double>, dim int, cell int, far double")


def _packs(rows: DataFrame, name: str, most: int, extra: dict[str, str]) -> DataFrame:
    """Rows (name, name_vec) and some more columns in packs of one vector length, of
    at most ``most`` values or one row: lists, and the vectors as one value."""
    columns = [name, *extra]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}
        rows: dict[int, int] = {}

        def done(n: int) -> pa.RecordBatch:
            told, vectors = zip(*held.pop(n))
            lists = [pa.concat_arrays(x) for x in zip(*told)]
            lists = [pa.ListArray.from_arrays(pa.array([0, rows[n]], pa.int32()), x) for x in lists]
            rows.pop(n)
            head = [pa.array([x], pa.int32()) for x in (part, made, n)]
            values = pa.array([np.concatenate(vectors).tobytes()], pa.binary())
            return pa.RecordBatch.from_arrays([*head, *lists, values], ["part", "pack", "dim", *columns, "vectors"])

        for batch in batches:
            for at, vectors in _by_length(batch.column(f"{name}_vec")):
                n = vectors.shape[1]
                room = max(1, most // n)
                told = [batch.column(c).take(pa.array(at)) for c in columns]
                begin = 0
                while begin < len(at):
                    take = min(len(at) - begin, room - rows.get(n, 0))
                    held.setdefault(n, []).append(([c.slice(begin, take) for c in told], vectors[begin : begin + take]))
                    rows[n] = rows.get(n, 0) + take
                    begin += take
                    if rows[n] == room:
                        yield done(n)
                        made += 1
        for n in sorted(held):
            yield done(n)
            made += 1

    kinds = {name: _kind(rows, name), **extra}
    lists = ", ".join(f"{c} array<{kind}>" for c, kind in kinds.items())
    return rows.mapInArrow(pack, f"part int, pack int, dim int, {lists}, vectors binary")


def index(items: DataFrame, id: str, vec: str, pivots: int = PIVOTS) -> tuple[DataFrame, Broadcast, DataFrame]:
    """Every vector in blocks ordered by cell, numbered by ``slot``; the pivots; and per
    cell its least and greatest distance from the pivot."""
    rows = _unit(items, id, vec, "item")
    chosen = _chosen(rows, pivots)
    placed = scale.stage(_placed(rows, chosen).withColumn("_at", F.monotonically_increasing_id()))
    cells = placed.groupBy("dim", "cell").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count("*").alias("rows"))
    ordered = placed.orderBy("dim", "cell", "_at").select("item", "item_vec", "cell")
    blocks = scale.stage(_packs(ordered, "item", BLOCK_VALUES, {"cell": "int"}))
    # One narrow row per block.
    number = (F.row_number().over(Window.orderBy("part", "pack")) - 1).alias("slot")
    numbers = blocks.select("part", "pack", number)
    return blocks.join(F.broadcast(numbers), ["part", "pack"]).drop("part", "pack"), chosen, scale.stage(cells)


def _first_visits(rows: DataFrame, pivots: Broadcast, first_cells: int) -> DataFrame:
    """The queries with the ``near``-est cell and the ``visits`` of the first round, a bit per cell."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, visits = np.zeros(batch.num_rows, np.int32), [b""] * batch.num_rows
            for at, vectors in _by_length(batch.column("query_vec")):
                known = _known(pivots, vectors)
                bits = np.zeros((len(at), len(known) + 1), bool)
                bits[:, -1] = True
                if len(known):
                    nearest = _distances(vectors, known).argsort(1, kind="stable")[:, :first_cells]
                    near[at] = nearest[:, 0]
                    bits[np.arange(len(at))[:, None], nearest] = True
                for n, told in zip(at.tolist(), np.packbits(bits, axis=1)):
                    visits[n] = told.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(visits, pa.binary())], [*batch.schema.names, "near", "visits"])

    return rows.mapInArrow(tell, f"query {_kind(rows, 'query')}, query_vec array<double>, near int, visits binary")


def _other_visits(rows: DataFrame, pivots: Broadcast, cells: DataFrame) -> DataFrame:
    """The queries, each with the ``bound`` it has so far, with visits of the cells in reach
    that they have not visited."""
    # At most as many cells as pivots, and one for each length of vectors.
    known = {(r.dim, r.cell): (r.low, r.high) for r in cells.collect()}
    radii = rows.sparkSession.sparkContext.broadcast(known)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            was = batch.column("visits").to_pylist()
            bounds = batch.column("bound").to_numpy(zero_copy_only=False)
            visits = [b""] * batch.num_rows
            for at, vectors in _by_length(batch.column("query_vec")):
                known = _known(pivots, vectors)
                seen = np.frombuffer(b"".join(was[n] for n in at), np.uint8).reshape(len(at), -1)
                seen = np.unpackbits(seen, axis=1, count=len(known) + 1).astype(bool)
                bits = ~seen
                if len(known):
                    ranges = [radii.value.get((vectors.shape[1], n), (np.inf, -np.inf)) for n in range(len(known))]
                    low, high = np.array(ranges).T
                    away = _distances(vectors, known)
                    reach = np.sqrt(np.maximum(2 - 2 * np.maximum(bounds[at], -1), 0))[:, None] + REACH_SLACK
                    # Not the other way round: what is not a number is in reach.
                    bits[:, :-1] &= ~((away - high > reach) | (low - away > reach))
                for n, told in zip(at.tolist(), np.packbits(bits, axis=1)):
                    visits[n] = told.tobytes()
            names = ["query", "query_vec", "near", "bound"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(visits, pa.binary())], [*names, "visits"])

    return rows.mapInArrow(tell, f"query {_kind(rows, 'query')}, query_vec array<double>, near int, bound double, visits binary")


def best_of_cell(queries: np.ndarray, own: np.ndarray, bounds: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """(query, vector, score) of the k best of each query that reach its bound, of
    equal scores those of lesser ``ids``; vectors of the query's ``own`` id are left out."""
    found = []
    step = max(1, SCORES // len(vectors))
    for begin in range(0, len(queries), step):
        part = queries[begin : begin + step]
        scores = part @ vectors.T
        others = own[begin : begin + step, None] != ids[None, :]
        kept = others & ~(scores < bounds[begin : begin + step, None] - SLACK)
        many = np.flatnonzero(kept.sum(1) > k)
        if len(many):
            seen = np.where(others[many], scores[many], -np.inf)
            least = np.partition(seen, len(vectors) - k, axis=1)[:, len(vectors) - k]
            kept[many] &= ~(seen < least[:, None] - SLACK)
        q, v = np.nonzero(kept)
        # The terms of a score are added from the first to the last.
        exact = np.zeros(len(q))
        for n in range(vectors.shape[1]):
            exact += part[q, n] * vectors[v, n]
        number = ~np.isnan(exact)
        order = np.lexsort([ids[v], np.where(number, -exact, 0), number, q])
        q, v, exact = q[order], v[order], exact[order]
        new = np.flatnonzero(np.diff(q, prepend=-1))
        nth = np.arange(len(q)) - np.repeat(new, np.diff(np.append(new, len(q))))
        found.append((q[nth < k] + begin, v[nth < k], exact[nth < k]))
    return [np.concatenate(x) for x in zip(*found)]


def _scored(blocks: DataFrame, slots: dict[tuple[int, int], list[int]], asked: DataFrame, k: int) -> DataFrame:
    """(query, item, score, scored): the best of the cells that queries visit, and
    rows without an item that tell how many items were scored."""
    has_bound = "bound" in asked.columns
    extra = {"visits": "binary"} | ({"bound": "double"} if has_bound else {})
    # Near queries lie together, so that packs visit few blocks.
    packs = _packs(asked.orderBy("near"), "query", PACK_VALUES, extra)
    where = asked.sparkSession.sparkContext.broadcast(slots)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for dim, visits in zip(batch.column("dim").to_pylist(), batch.column("visits").to_pylist()):
                some = np.bitwise_or.reduce(np.frombuffer(b"".join(visits), np.uint8).reshape(len(visits), -1), axis=0)
                cells = np.flatnonzero(np.unpackbits(some)).tolist()
                told.append(sorted({slot for cell in cells for slot in where.value.get((dim, cell), ())}))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, pa.list_(pa.int32()))], [*batch.schema.names, "slots"])

    lists = f"query array<{_kind(asked, 'query')}>, visits array<binary>" + (", bound array<double>" if has_bound else "")
    packs = packs.mapInArrow(route, f"part int, pack int, dim int, {lists}, vectors binary, slots array<int>")
    packs = packs.withColumn("slot", F.explode("slots")).drop("part", "pack", "slots").withColumn("kind", F.lit(1))
    both = blocks.withColumn("kind", F.lit(0)).unionByName(packs, allowMissingColumns=True)
    parts = 2 * max(1, len({slot for some in slots.values() for slot in some}))
    dealt = both.repartition(parts, "slot").sortWithinPartitions("slot", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code: dict = {}
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n] for c in batch.schema.names}
                vectors = np.frombuffer(row["vectors"].as_buffer(), "<f8").reshape(-1, row["dim"].as_py())
                if row["kind"].as_py() == 0:
                    slot, items, names = row["slot"].as_py(), vectors, row["item"].values
                    told = names.to_pylist()
                    code = {x: i for i, x in enumerate(sorted(set(told)))}
                    ids = np.array([code[x] for x in told])
                    cells = row["cell"].values.to_numpy()
                    edges = np.flatnonzero(np.diff(cells, prepend=-1, append=-1))
                    continue
                queries = row["query"].values
                own = np.array([code.get(x, -1) for x in queries.to_pylist()])
                visits = np.frombuffer(b"".join(row["visits"].as_py()), np.uint8).reshape(len(queries), -1)
                visits = np.unpackbits(visits, axis=1)
                bounds = row["bound"].values.to_numpy(zero_copy_only=False) if has_bound else np.full(len(queries), -np.inf)
                seen = np.zeros(len(queries), np.int64)
                for a, b in zip(edges[:-1], edges[1:]):
                    some = np.flatnonzero(visits[:, cells[a]])
                    if len(some):
                        q, v, score = best_of_cell(vectors[some], own[some], bounds[some], items[a:b], ids[a:b], k)
                        seen[some] += b - a - (own[some, None] == ids[None, a:b]).sum(1)
                        yield made(queries.take(pa.array(some[q])), names.take(pa.array(v + a)), score, None)
                told = np.flatnonzero(seen)
                yield made(queries.take(pa.array(told)), None, None, seen[told])

    query, item = _kind(asked, "query"), _kind(blocks, "item")[len("array<") : -1]
    target = to_arrow_schema(StructType.fromDDL(f"query {query}, item {item}, score double, scored bigint"))

    def made(*columns) -> pa.RecordBatch:
        rows = len(columns[0])
        arrays = [pa.nulls(rows, f.type) if x is None else (x if isinstance(x, pa.Array) else pa.array(x)).cast(f.type) for x, f in zip(columns, target)]
        return pa.RecordBatch.from_arrays(arrays, schema=target)

    return dealt.mapInArrow(search, f"query {query}, item {item}, score double, scored bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    return found.where("item IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_candidates(
    items: DataFrame, queries: DataFrame, id: str, vec: str, k: int, pivots: int = PIVOTS, first_cells: int = FIRST_CELLS
) -> tuple[DataFrame, DataFrame]:
    """The k items of highest cosine of each query (query, item, rank, score), of equal
    scores the lesser id, a query's own id left out; and per query how many items
    were scored (``scored``) of how many (``items``)."""
    blocks, chosen, cells = index(items, id, vec, pivots)
    # Where the cells are: a narrow row per block and cell in it.
    slots: dict[tuple[int, int], list[int]] = {}
    for dim, cell, slot in blocks.select("dim", F.explode(F.array_distinct("cell")).alias("cell"), "slot").collect():
        slots.setdefault((dim, cell), []).append(slot)
    asked = scale.stage(_first_visits(_unit(queries, id, vec, "query"), chosen, first_cells))
    early = scale.stage(_scored(blocks, slots, asked, k))
    bound = _best(early, k).groupBy("query").agg(F.count("*").alias("_n"), F.min("score").alias("_least")).where(F.col("_n") >= k)
    # A query with fewer than k so far must look everywhere.
    bounded = asked.join(bound, "query", "left").withColumn("bound", F.coalesce("_least", F.lit(float("-inf"))))
    rest = _other_visits(bounded.select("query", "query_vec", "near", "visits", "bound"), chosen, cells)
    later = scale.stage(_scored(blocks, slots, rest, k))
    whole = early.unionByName(later)
    total = cells.agg(F.sum("rows").alias("items"))
    counts = whole.groupBy("query").agg(F.sum("scored").alias("scored")).withColumn("items", total.select("items").scalar())
    return _best(whole, k).select("query", "item", "rank", "score"), counts
