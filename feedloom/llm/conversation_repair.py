"""Conversations made well-formed again by the cheapest edits.

A well-formed conversation is empty, or has an optional system turn and then user
and assistant in turn: role initials ``(s?(ua)+)?``. Each row is kept (0), given
the role user or assistant (1) or deleted (2); turns of empty text may be inserted
anywhere (5). Blank rows and rows seen before have to go, truncated rows that stay
cost 5 more. Of equally cheap edits those whose initials (the audit) are least in
ASCII are taken.

The search is a depth-first branch-and-bound with an explicit stack. A node is
(rows consumed, what the output ends with). A bound is kept per node: the cost
below which no edits of the rows that remain can lead to a well-formed end. The
incumbent is (cost, audit), deletion of everything at first; a branch goes when
its cost and bound exceed the incumbent's cost, or equal it while its audit is
already greater. A table per node keeps the best (cost, audit) that reached it and
drops worse prefixes: with equal costs neither audit begins the other, so that the
lesser one stays the lesser whatever follows. When the stack is empty the
incumbent is proved best. The bounds are tight, so that time and memory grow with
the rows of a conversation and not with their powers.

A conversation is one sequence, so its rows come to one task, sorted, and one
conversation is held at a time; conversations are dealt by id.

Edge cases: a null role or text is one space. Rows of a conversation are ordered
by turn, nulls first, then role, then text. Null ids form one conversation. Rows
whose ``dropped`` column is true only keep their conversation in the result; if
nothing else is left, all counts are zero and audit and texts are empty. A role
is judged by its first character; an empty role has none and cannot be kept.
Repeated rows are duplicates. An empty table gives no conversations. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm import common

# Costs of the edits, and white space.
RETOLD, DELETED, INSERTED, TRUNCATED = 1, 2, 5, 5
BLANKS = " \t\n\v\f\r"
LEGAL = ("su", "ua", "au")

# What the output ends with: nothing, a system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
# The only turn that may be made up after each end.
_MADE = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_FINAL = (START, ASSISTANT)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_NEVER = 1 << 60


class Row(NamedTuple):
    """What the search has to know of a row: its role's initial and its fault."""

    initial: str
    fault: str | None = None


class _Prefix(NamedTuple):
    """Edits made so far, as a chain from the last to the first."""

    rows: int
    end: int
    cost: int
    depth: int
    letter: str
    before: _Prefix | None


def _edges(row: Row | None, end: int) -> Iterator[tuple[str, int, int, int]]:
    """(letter, cost, rows consumed, new end) of each edit, by letter; the letters differ."""
    if row is not None:
        yield "D", DELETED, 1, end
    yield "I", INSERTED, 0, _MADE[end]
    if row is not None and row.fault not in ("blank", "duplicate"):
        more = TRUNCATED if row.fault == "truncated" else 0
        if (kept := _KEPT.get(row.initial, {}).get(end)) is not None:
            yield "K", more, 1, kept
        yield "R", RETOLD + more, 1, _MADE[end]


def suffix_bounds(rows: list[Row]) -> list[list[int]]:
    """Per number of consumed rows and end: no completion costs less."""
    bounds = [[0 if end in _FINAL else _NEVER for end in range(4)]]
    for at in range(len(rows), -1, -1):
        if at < len(rows):
            later = bounds[-1]
            bounds.append([min(cost + later[to] for _, cost, eaten, to in _edges(rows[at], end) if eaten) for end in range(4)])
        here = bounds[-1]
        # Two insertions in a row reach every end that insertions can reach.
        for _ in range(2):
            for end in range(4):
                here[end] = min(here[end], INSERTED + here[_MADE[end]])
    return bounds[::-1]


def _chain(prefix: _Prefix) -> list[_Prefix]:
    """All beginnings of a prefix, the empty one first."""
    out = []
    while prefix is not None:
        out.append(prefix)
        prefix = prefix.before
    return out[::-1]


def _letters(prefix: _Prefix) -> str:
    return "".join(p.letter for p in _chain(prefix))


def cheapest(rows: list[Row]) -> tuple[int, str]:
    """The least (cost, audit) that makes the rows well-formed."""
    bounds = suffix_bounds(rows)
    root = _Prefix(0, START, 0, 0, "", None)
    best, chain = (DELETED * len(rows), "D" * len(rows)), [root]
    for n in range(len(rows)):
        chain.append(_Prefix(n + 1, START, DELETED * (n + 1), n + 1, "D", chain[-1]))
    reached: dict[tuple[int, int], _Prefix] = {}
    stack = [root]

    def hopeless(p: _Prefix) -> bool:
        least = p.cost + bounds[p.rows][p.end]
        if least != best[0] or p is root:
            return least > best[0]
        # Next to the incumbent's own edits one letter decides.
        if p.depth < len(chain) and chain[p.depth - 1] is p.before:
            if p.letter == chain[p.depth].letter:
                chain[p.depth] = p
            return p.letter > chain[p.depth].letter
        return _letters(p) > best[1][: p.depth]

    while stack:
        prefix = stack.pop()
        if hopeless(prefix):
            continue
        node = prefix.rows, prefix.end
        rival = reached.get(node)
        if rival and (rival.cost < prefix.cost or rival.cost == prefix.cost and _letters(rival) <= _letters(prefix)):
            continue
        reached[node] = prefix
        if prefix.rows == len(rows) and prefix.end in _FINAL:
            found = prefix.cost, _letters(prefix)
            if found <= best:
                best, chain = found, _chain(prefix)
            continue  # more insertions only cost more
        row = rows[prefix.rows] if prefix.rows < len(rows) else None
        made = [
            _Prefix(prefix.rows + eaten, end, prefix.cost + cost, prefix.depth + 1, letter, prefix)
            for letter, cost, eaten, end in _edges(row, prefix.end)
        ]
        # The most promising branch is popped first, of equal ones the least letter.
        made.sort(key=lambda p: (p.cost + bounds[p.rows][p.end], p.letter), reverse=True)
        stack += made
    return best


def applied(audit: str, turns: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(role, text) after the edits."""
    out, end, rest = [], START, iter(turns)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rest)
        if letter == "D":
            continue
        end = _KEPT[role[0]][end] if letter == "K" else _MADE[end]
        out.append((role if letter == "K" else _NAMES[end], text))
    return out


def faults(turns: list[tuple[str, str]]) -> list[Row]:
    """Each row's first fault."""
    seen, out = set(), []
    for role, text in turns:
        said = text.rstrip(BLANKS)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else None if said[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append(Row(role[:1], fault))
    return out


def repaired(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    dropped: str | None = None,
) -> DataFrame:
    """A row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit and the repaired turns (role, text)."""
    space, named = F.lit(" "), lambda c: F.col(f"`{c}`")
    rows = conversations.select(
        named(conv_id).alias("_conv"), named(turn).cast("bigint").alias("_turn"),
        F.coalesce(named(role), space).alias("_role"), F.coalesce(named(text), space).alias("_text"),
        (F.coalesce(named(dropped), F.lit(False)) if dropped else F.lit(False)).alias("_gone"),
    )
    key_type = rows.schema["_conv"].dataType.simpleString()
    dealt = rows.repartition("_conv").sortWithinPartitions("_conv", "_turn", "_role", "_text")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    names = ["conv_id", *counts, "audit", "turns"]

    def one(key, numbers: list[int | None], turns: list[tuple[str, str]]) -> list:
        told = faults(turns)
        known = {n for n in numbers if n is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        found = [sum(r.fault == x for r in told) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(a.initial + b.initial not in LEGAL for a, b in zip(told, told[1:]))
        cost, audit = cheapest(told)
        said = [{"role": r, "text": t} for r, t in applied(audit, turns)]
        return [key, gaps, *found, illegal, cost, audit, said]

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        key, numbers, turns, begun = None, [], [], False
        for batch in batches:
            for part in common.sliced(batch):
                out = []
                for conv, number, who, said, gone in zip(*[c.to_pylist() for c in part.columns]):
                    if begun and conv != key:
                        out.append(one(key, numbers, turns))
                        numbers, turns = [], []
                    key, begun = conv, True
                    if not gone:
                        numbers.append(number)
                        turns.append((who, said))
                if out:
                    yield dict(zip(names, map(list, zip(*out))))
        if begun:
            yield {x: [v] for x, v in zip(names, one(key, numbers, turns))}

    longs = ", ".join(f"{c} bigint" for c in counts)
    schema = f"conv_id {key_type}, {longs}, audit string, turns array<struct<role:string,text:string>>"
    return common.arrow_map(dealt, repair, schema)


def digest(turns: Column) -> Column:
    """SHA-256 of ``role:text`` of the turns, joined by line breaks."""
    return F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"), 256)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) damaged by a hash of their place, to
    try the repair on: of twenty rows one each is dropped (column ``dropped``),
    emptied, robbed of its end marks, said twice, and given to the user."""
    space = F.lit(" ")
    place = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        F.pmod(F.crc32(F.concat_ws(":", *place).cast("binary")), F.lit(20)).alias("_fate"),
    )
    fate = F.col("_fate")
    cut = F.regexp_replace("text", "[.!?]", "")
    return rows.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fate == 1, "").when(fate == 2, cut).otherwise(F.col("text")).alias("text"), (fate == 0).alias("dropped"),
        F.explode(F.sequence(F.lit(1), F.when(fate == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")
