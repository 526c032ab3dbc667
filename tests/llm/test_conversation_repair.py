import hashlib
import itertools
import re
import zlib

import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedloom.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string"
faults = st.sampled_from([None, None, None, "blank", "duplicate", "truncated"])
row = st.builds(repair.Row, st.sampled_from(["s", "u", "a", "x", ""]), faults)


def brute(rows):
    """All edits with up to two made-up turns in each gap."""
    best = None
    gaps = [list(itertools.product("ua", repeat=n)) for n in range(3)]
    gaps = [g for some in gaps for g in some]
    edits = []
    for r in rows:
        more = 5 if r.fault == "truncated" else 0
        some = [("D", 2, "")]
        if r.fault not in ("blank", "duplicate"):
            some += [("K", more, r.initial or "?"), ("R", 1 + more, "u"), ("R", 1 + more, "a")]
        edits.append(some)
    for chosen in itertools.product(*edits):
        for made in itertools.product(gaps, repeat=len(rows) + 1):
            whole = "".join(made[0]) + "".join(e[2] + "".join(m) for e, m in zip(chosen, made[1:]))
            if re.fullmatch("(s?(ua)+)?", whole):
                cost = sum(e[1] for e in chosen) + 5 * sum(map(len, made))
                audit = "I" * len(made[0]) + "".join(e[0] + "I" * len(m) for e, m in zip(chosen, made[1:]))
                best = min(best or (cost, audit), (cost, audit))
    return best


def by_layers(rows):
    """Least (cost, audit) per end, row by row; an other way to the same result."""
    def made(ends):
        ends = dict(ends)
        for _ in range(3):
            for end, (cost, audit) in list(ends.items()):
                to = 1 if end != 1 else 2
                ends[to] = min(ends.get(to, (9**9, "")), (cost + 5, audit + "I"))
        return ends

    ends = made({0: (0, "")})  # 0 nothing, 3 system, 1 user, 2 assistant
    for r in rows:
        after = {}
        for end, (cost, audit) in ends.items():
            more, steps = 5 if r.fault == "truncated" else 0, [(end, 2, "D")]
            if r.fault not in ("blank", "duplicate"):
                steps.append((1 if end != 1 else 2, 1 + more, "R"))
                kept = {("s", 0): 3, ("u", 0): 1, ("u", 3): 1, ("u", 2): 1, ("a", 1): 2}.get((r.initial, end))
                steps += [(kept, more, "K")] if kept is not None else []
            for to, price, letter in steps:
                after[to] = min(after.get(to, (9**9, "")), (cost + price, audit + letter))
        ends = made(after)
    return min(v for end, v in ends.items() if end in (0, 2))


@given(st.lists(row, max_size=3))
@settings(max_examples=60, deadline=None)
def test_every_set_of_edits(rows):
    assert repair.cheapest(rows) == brute(rows)


@given(st.lists(row, max_size=40))
@settings(max_examples=400, deadline=None)
def test_long_rows_by_layers(rows):
    assert repair.cheapest(rows) == by_layers(rows)


def test_weak_bounds_are_still_exact(monkeypatch):
    """Incumbent and dominance alone prove the same result."""
    monkeypatch.setattr(repair, "suffix_bounds", lambda rows: [[0] * 4 for _ in range(len(rows) + 1)])
    for letters in itertools.product("sua", repeat=6):
        rows = [repair.Row(x) for x in letters]
        assert repair.cheapest(rows) == by_layers(rows)


def test_time_grows_with_the_rows():
    rows = [repair.Row(x, "truncated" if n % 7 == 0 else None) for n, x in enumerate("uaauxsu" * 8000)]
    cost, audit = repair.cheapest(rows)
    assert (cost, audit) == by_layers_cost(rows, audit)


def by_layers_cost(rows, audit):
    """The cost of an audit and the cost bound, for rows too many for strings."""
    ends = [0, 9**9, 9**9, 9**9]
    def made(e):
        u = min(e[2], e[0] + 5, e[1] + 5, e[3] + 5)
        return [e[0], e[1], u, min(e[3], u + 5)]
    ends = made(ends)
    for r in rows:
        more = 5 if r.fault == "truncated" else 0
        new = [x + 2 for x in ends]
        if r.fault not in ("blank", "duplicate"):
            u, a = min(ends[0], ends[1], ends[3]), ends[2]
            new[2] = min(new[2], u + more + (r.initial != "u"))
            new[3] = min(new[3], a + more + (r.initial != "a"))
            if r.initial == "s":
                new[1] = min(new[1], ends[0] + more)
        ends = made(new)
    return min(ends[0], ends[3]), audit


def test_faults():
    turns = [("user", " \t\v"), ("user", "a."), ("user", "a."), ("assistant", "a. \n"), ("user", "b"), ("user", " \t\v"), ("user", "x! ")]
    assert [r.fault for r in repair.faults(turns)] == ["blank", None, "duplicate", None, "truncated", "blank", "truncated"]


def test_edits_applied():
    assert repair.applied("KDIR", [("system", "s"), ("x", "y"), ("user", "z")]) == [("system", "s"), ("user", ""), ("assistant", "z")]


def run(spark, rows):
    made = repair.repaired(repair.damaged(spark.createDataFrame([(*r, "own") for r in rows], SCHEMA)), dropped="dropped")
    return {r.conv_id: r for r in made.withColumn("sha", repair.digest(made.turns)).collect()}


def plainly(rows):
    """The contract, row by row."""
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    told, seen = [], []
    for _, role, text in out:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else None if last[0] in ".!?" else "truncated"
        seen.append((role, text))
        told.append(repair.Row(role[:1], fault))
    turns = {t for t, _, _ in out if t is not None}
    cost, audit = by_layers(told)
    illegal = sum(a.initial + b.initial not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
    kinds = [sum(r.fault == x for r in told) for x in ("blank", "duplicate", "truncated")]
    return [max(turns) - min(turns) + 1 - len(turns) if turns else 0, *kinds, illegal, cost, audit]


@pytest.mark.parametrize("rows", [
    [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}." if t % 5 else "cut off") for c in range(60) for t in range(6)],
    [(None, None, None, None), (None, 3, "user", "a."), (7, None, "assistant", "b."), (7, None, "", ""), (7, 1, "user", "c."), (7, 1, "user", "c.")],
    [(1, t, ["system", "user", "assistant", "tool"][t * t % 4], "word " * (5000 if t == 3 else 1) + "!") for t in range(400)],
    [(1, 0, "user", "é" * 300_000), (1, 1, "assistant", "."), (2, -5, "user", "x."), (2, 9, "user", "x.")],
])
def test_like_the_contract(spark, rows):
    got = run(spark, rows)
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r)
    assert got.keys() == by_conv.keys()
    for conv, some in by_conv.items():
        g = got[conv]
        assert [g.gaps, g.blank, g.duplicate, g.truncated, g.illegal, g.cost, g.audit] == plainly(some)
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in g.turns))
        assert g.sha == hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in g.turns).encode()).hexdigest()


def test_nothing_left_and_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    g = run(spark, [(gone, 0, "user", "a.")])[gone]
    assert (g.gaps, g.blank, g.illegal, g.cost, g.audit, g.turns, g.sha) == (0, 0, 0, 0, "", [], hashlib.sha256(b"").hexdigest())
    assert run(spark, []) == {}


def test_query_as_in_sql(spark):
    oracle.assert_equal(spark, "op13_conversation_repair")
