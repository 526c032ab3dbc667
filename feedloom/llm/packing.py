"""Documents packed into sequences of a fixed number of tokens, costs balanced.

Training on a sequence costs a share per token and a share per pair of tokens of
one piece (attention stays inside pieces), so a piece of n tokens is taken to
cost n + n^2 / PAIR_TOKENS. Packing is local: a task takes documents until they
fill a block of sequences, cuts whole sequences off long documents, and hands the
rest out in descending cost, each to the cheapest sequence with room for it. As
many sequences are open as the tokens of the block need; when none has room for
a piece, it is cut and fills the cheapest open one. Hence only the last sequence
of a block is not full. Nothing is shuffled, and a task holds one block.

Edge cases: a null text is empty and has only its end token. Repeated rows are
packed each. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm import common, tokens

SEQUENCE_TOKENS = 1024
BLOCK_SEQUENCES = 512
# At this length the pairs of a piece cost as much as its tokens.
PAIR_TOKENS = 2048
# Sequence numbers: partition above, sequence of the partition below.
SEQUENCE_BITS = 33

Piece = tuple[int, int, int, int, int]


def cost(tokens: int) -> float:
    return tokens + tokens * tokens / PAIR_TOKENS


def assign(sizes: list[int], room: int = SEQUENCE_TOKENS) -> Iterator[Piece]:
    """(document, start, length, sequence, offset) of every piece of a block."""
    n = -(-sum(sizes) // room)
    used, costs = np.zeros(n, np.int64), np.zeros(n)
    waiting, sequence = [], 0
    for document, size in enumerate(sizes):
        for start in range(0, size - room + 1, room):
            yield document, start, room, sequence, 0
            used[sequence], costs[sequence] = room, cost(room)
            sequence += 1
        if size % room:
            waiting.append((-(size % room), document, size - size % room))
    heapq.heapify(waiting)
    while waiting:
        length, document, start = heapq.heappop(waiting)
        length = -length
        fits = used <= room - length
        if not fits.any():
            fits = used < room
        at = int(np.argmin(np.where(fits, costs, np.inf)))
        taken = min(length, room - int(used[at]))
        yield document, start, taken, at, int(used[at])
        used[at] += taken
        costs[at] += cost(taken)
        if taken < length:
            heapq.heappush(waiting, (taken - length, document, start + taken))


def packed(
    docs: DataFrame,
    tokenizer_path: str,
    id: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    room: int = SEQUENCE_TOKENS,
    keep_ids: bool = False,
) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32 (of its ids as little-endian
    32-bit words), doc_tokens, sequence_id, offset, and its ids if asked for."""
    file = tokens.shipped(docs.sparkSession, tokenizer_path)
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        encoder = tokens.encoder(file.value)
        first = TaskContext.get().partitionId() << SEQUENCE_BITS
        keys: list = []
        held: list[np.ndarray] = []

        def block() -> dict[str, list]:
            out = {x: [] for x in names}
            for document, start, length, sequence, offset in assign([len(x) for x in held], room):
                ids = held[document][start : start + length]
                row = [keys[document], start, length, zlib.crc32(ids), len(held[document]), first + sequence, offset, ids]
                for x, v in zip(names, row):
                    out[x].append(v)
            return out

        end, total = np.array([end_id], "<u4"), 0
        for batch in batches:
            for part in common.sliced(batch, 128):
                for key, value in zip(part.column("_id").to_pylist(), part.column("_text").to_pylist()):
                    keys.append(key)
                    held.append(np.concatenate([encoder(value or "").astype("<u4"), end]))
                    total += len(held[-1])
                    if total >= BLOCK_SEQUENCES * room:
                        yield block()
                        first += -(-total // room)
                        keys, held, total = [], [], 0
        if held:
            yield block()

    schema = "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    rows = docs.select(F.col(id).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    return common.arrow_map(rows, pack, schema + (", ids array<bigint>" if keep_ids else ""))
