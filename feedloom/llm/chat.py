"""Conversations formatted by a template that is only asked to render.

The turns of a conversation come to one task in order. Each prefix of them is
rendered; consecutive outputs are compared. If the former begins the latter, what
was added is the new turn's span; if not, the template rewrites history. Where the
text lies inside a span is found by rendering the prefix with two short probe texts: they
differ first where the text begins, and what follows the probe closes the turn.

The given template marks turns and escapes its control characters inside texts
and roles, so that the output can be read back.

A task streams over its sorted rows and holds one conversation; rendering its
prefixes takes time with the square of its turns, as any black box would.

Edge cases: null texts and roles are empty. Turns of equal number are ordered by
role and text, turns without a number come first, rows without a conversation id
form one conversation. If a template rewrites history, ``rewrites`` is true and
the turns concerned have no span; they are not trained on. An empty table gives
no conversations. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm import common

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# Fixed values of the template.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
_CONTROL = re.compile(r"[\\#<:]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\#<:]+|\\.)*): ((?:[^\\#<:]+|\\.)*)</turn>\n", re.DOTALL)

SPANS = "array<struct<start:bigint,end:bigint>>"


@functools.lru_cache(maxsize=2048)
def escaped(text: str) -> str:
    """Remembered, as each turn is rendered once per later turn."""
    return _CONTROL.sub(r"\\\g<0>", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marked_turns(turns: list[Turn]) -> str:
    """The template: marks around each turn, control characters escaped."""
    return "".join(OPEN + escaped(role) + MIDDLE + escaped(text) + CLOSE for role, text in turns)


def read_turns(formatted: str) -> list[Turn]:
    """The turns of a text that ``marked_turns`` made."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        turns.append((unescaped(found[1]), unescaped(found[2])))
        at = found.end()
    return turns


def shared_start(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def spans(turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int] | None], list[tuple[int, int] | None], bool]:
    """The output, the span of each turn and of its text, and whether any prefix
    was rewritten by a later turn."""
    whole, of_turn, of_text, rewrites = template([]) if not turns else "", [], [], False
    before = template([])
    for n, (role, text) in enumerate(turns):
        whole = template(turns[: n + 1])
        if not whole.startswith(before):
            # Earlier spans hold only as far as the outputs agree.
            agreed = shared_start(before, whole)
            for held in (of_turn, of_text):
                held[:] = [s if s and s[1] <= agreed else None for s in held]
            of_turn.append(None)
            of_text.append(None)
            rewrites = True
        else:
            of_turn.append((len(before), len(whole)))
            a, b = (template([*turns[:n], (role, probe)]) for probe in ("A", "B"))
            start = shared_start(a, b)
            closing = len(a) - start - 1
            end = len(whole) - closing
            found = start <= end and whole[:start] == a[:start] and whole[end:] == a[start + 1 :]
            of_text.append((start, end) if found else None)
        before = whole
    return whole, of_turn, of_text, rewrites


def formatted(
    conversations: DataFrame,
    template: Template = marked_turns,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    trained: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """A row per conversation: conv_id, formatted, n_turns, turn_spans, loss_spans
    (texts of the trained roles, in code points) and rewrites."""
    empty = F.lit("")
    rows = conversations.select(
        F.col(conv_id).cast("bigint").alias("_conv"), F.col(turn).alias("_turn"),
        F.coalesce(F.col(role), empty).alias("_role"), F.coalesce(F.col(text), empty).alias("_text"),
    )
    dealt = rows.repartition("_conv").sortWithinPartitions("_conv", "_turn", "_role", "_text")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        def one(key: int | None, turns: list[Turn]) -> tuple:
            whole, of_turn, of_text, rewrites = spans(turns, template)
            loss = [s for (role, _), s in zip(turns, of_text) if role in trained and s]
            pairs = [[None if s is None else {"start": s[0], "end": s[1]} for s in x] for x in (of_turn, loss)]
            return key, whole, len(turns), *pairs, rewrites

        names = ["conv_id", "formatted", "n_turns", "turn_spans", "loss_spans", "rewrites"]
        key, turns, began = None, [], False
        for batch in batches:
            out: dict[str, list] = {x: [] for x in names}
            for conv, who, said in zip(*[batch.column(c).to_pylist() for c in ("_conv", "_role", "_text")]):
                if began and conv != key:
                    for x, v in zip(names, one(key, turns)):
                        out[x].append(v)
                    turns = []
                key, began = conv, True
                turns.append((who, said))
            yield out
        if began:
            yield {x: [v] for x, v in zip(names, one(key, turns))}

    schema = f"conv_id bigint, formatted string, n_turns bigint, turn_spans {SPANS}, loss_spans {SPANS}, rewrites boolean"
    return common.arrow_map(dealt, render, schema)


def read_back(output: DataFrame) -> DataFrame:
    """Digests of what the formatted texts and their loss spans hold."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            for part in common.sliced(batch):
                rows = []
                columns = [part.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")]
                for key, whole, loss in zip(*columns):
                    turns = read_turns(whole)
                    told = "".join(f"{role}\n{text}\n" for role, text in turns)
                    trained = "".join(unescaped(whole[s["start"] : s["end"]]) for s in loss)
                    hashes = [hashlib.sha256(x.encode()).hexdigest() for x in (told, trained)]
                    rows.append((key, len(turns), hashes[0], len(trained), hashes[1], len(whole)))
                names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
                yield dict(zip(names, map(list, zip(*rows))))

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return common.arrow_map(output.select("conv_id", "formatted", "loss_spans"), read, schema)
