import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedloom.llm import order_minhash as om, queries

SCHEMA = "doc_id long, text string, _words int, n int"


def words(n, seed):
    own = random.Random(seed)
    return ["".join(own.choices("abcdefghij", k=6)) for _ in range(n)]


def classes(spark, rows):
    got = om.near_duplicates(spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    return {r.doc_id: r.class_id for r in got}, got


def plain_similarity(a, b):
    """Longest common subsequence by the full table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return row[-1] / (len(a) + len(b) - row[-1])


@given(st.lists(st.integers(0, 3), min_size=1, max_size=30), st.lists(st.integers(0, 3), min_size=1, max_size=30), st.sampled_from([0.0, 0.5, 0.8]))
@settings(max_examples=300, deadline=None)
def test_alignment_equals_the_full_table(a, b, least):
    exact = plain_similarity(a, b)
    got = om.matched(np.array(a, np.uint64), np.array(b, np.uint64), least)
    assert got == pytest.approx(exact) if exact >= least and exact > 0 else got == 0.0


def test_sketches_follow_order():
    shingles = om.Shingles()
    one = words(300, 1)
    changed = [*one[:150], "new", *one[151:]]
    turned = [*one[150:], *one[:150]]
    base, near, far = (om.sketches(shingles(shingles.words(" ".join(w)))) for w in (one, changed, turned))
    assert sum(a == b for a, b in zip(base, near)) > sum(a == b for a, b in zip(base, far)) + 5


def test_near_copies_are_one_class(spark):
    base = words(400, 2)
    rows = [(10, " ".join(base)), (11, " ".join(base).upper()), (12, " ".join([*base[:200], "x", *base[201:]])),
            (13, " ".join(base[:380])), (14, " ".join(words(400, 3))), (15, " ".join(base[:200] + words(200, 4)))]
    got, _ = classes(spark, rows)
    assert got == {10: 10, 11: 10, 12: 10, 13: 10, 14: 14, 15: 15}


def test_chains_and_large_groups(spark):
    rows, text = [], words(200, 5)
    for i in range(12):  # each differs from the next by one word
        rows.append((i, " ".join(text)))
        text = [*text[: 15 * i], f"new{i}", *text[15 * i + 1 :]]
    base = words(150, 6)
    for i in range(100, 400):
        own = list(base)
        own[i % 150] = f"x{i}"
        rows.append((i, " ".join(own)))
    got, _ = classes(spark, rows)
    assert {got[i] for i in range(12)} == {0} and {got[i] for i in range(100, 400)} == {100}


def test_nulls_empty_short_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, "?!"), (4, "one two"), (5, "One, two."), (6, "two one"), (7, "same " * 3000), (7, "same " * 3000), (None, "one two"), (None, None)]
    got, all_rows = classes(spark, rows)
    assert {k: v for k, v in got.items() if k} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}
    assert {(r.class_id, r._first) for r in all_rows if r.doc_id is None} == {(4, False), (None, True)}


def test_no_documents(spark):
    assert classes(spark, [])[0] == {}


def test_classes_equal_brute_force(spark):
    from conftest import SF_DIR

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    shingles = om.Shingles()
    found = {k: shingles(shingles.words(t or "")) for k, t in docs}
    root = {k: k for k in found}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(found)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if om.matched(found[a], found[b], 0.8):
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = queries.QUERIES["op6_minhash_dedup"](spark, SF_DIR).collect()
    assert {r.doc_id: r.class_id for r in got} == {k: find(k) for k in keys}
    assert len({find(k) for k in keys}) < len(keys)


def test_short_pairs_at_the_bound_are_all_found(spark):
    rows = []
    for i in range(300):
        own = words(9, 1000 + i)  # 4 shingles of 5, then 8 of 10 in a row of 14 words
        rows += [(4 * i, " ".join(own[:8])), (4 * i + 1, " ".join(own))]
        longer = words(14, 5000 + i)
        rows += [(4 * i + 2, " ".join(longer[:12])), (4 * i + 3, " ".join(longer))]
    got, _ = classes(spark, rows)
    assert [k for k, v in got.items() if v != k - k % 2] == []


def test_one_agreeing_sketch_is_enough(spark):
    rows, k = [], 0
    while len(rows) < 6:  # texts of a similarity of 0.5 or more that agree in one sketch only
        base, k = words(120, 9000 + k), k + 1
        other = [f"y{i}" if i % 17 == 9 else w for i, w in enumerate(base)]
        shingles = om.Shingles()
        a, b = (shingles(shingles.words(" ".join(w))) for w in (base, other))
        if om.matched(a, b, 0.5) and sum(x == y for x, y in zip(om.sketches(a), om.sketches(b))) == 1:
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    got = om.near_duplicates(docs, similarity=0.5).collect()
    assert {r.doc_id: r.class_id for r in got} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


def plain_shingles(text):
    """Five-word shingles by the definition, as tuples."""
    found = re.findall(r"\w+", text.lower())
    return [tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))] if found else []


@given(st.lists(st.sampled_from("a b c d É é _x 1 ! , - \n".split(" ")), max_size=40).map(" ".join))
@settings(max_examples=300, deadline=None)
def test_shingles_by_definition(text):
    shingles = om.Shingles()
    got, wanted = shingles(shingles.words(text)), plain_shingles(text)
    assert len(got) == len(wanted)
    assert [[x == y for y in got.tolist()] for x in got.tolist()] == [[x == y for y in wanted] for x in wanted]
    seen = Counter()
    numbered = [(x, seen.update([x]) or seen[x]) for x in wanted]
    marks = om.labelled(got).tolist() if wanted else []
    assert len(set(marks)) == len(set(numbered)) == len(wanted)


def test_counts_of_shared_marks(monkeypatch):
    monkeypatch.setattr(om, "TILE_MARKS", 3)
    own = random.Random(4)
    sets = [np.array(sorted(own.sample(range(40), own.randint(1, 20))), np.uint64) for _ in range(12)]
    got = om.shared_marks(sets[:5], sets[5:])
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[5:]] for a in sets[:5]]


def template(n, size, replaced, seed):
    """Texts of one template with some words replaced."""
    own, base = random.Random(seed), words(size, seed)
    rows = []
    for i in range(n):
        text = list(base)
        for k in own.sample(range(size), replaced):
            text[k] = "".join(own.choices("klmnopqrst", k=6))
        rows.append((i, " ".join(text)))
    return rows


def brute_classes(rows, similarity=0.8):
    shingles, root = om.Shingles(), {k: k for k, _ in rows}
    found = {k: shingles(shingles.words(t)) for k, t in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, _) in enumerate(rows):
        for b, _ in rows[:i]:
            if find(a) != find(b) and om.matched(found[a], found[b], similarity):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in root}


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("size,replaced", [(40, 2), (90, 2), (150, 3)])
def test_texts_of_a_template(spark, monkeypatch, small, size, replaced):
    """Near the bound, where the leader joins some only, no link of short texts goes."""
    if small:
        monkeypatch.setattr(om, "TILE", 3)
        monkeypatch.setattr(om, "FEW", 200)  # all candidates, as of short texts
    elif size > 40:
        monkeypatch.setattr(om, "FEW", 200)
    rows = template(120, size, replaced, size)
    got, _ = classes(spark, rows)
    assert got == brute_classes(rows)
    assert 1 < len(set(got.values()))


def test_made_rows_follow_the_texts():
    """Tiles: what leaves a task is at most a link per text."""
    rows = template(300, 120, 2, 7)
    shingles = om.Shingles()
    tile = [(k, k, shingles(shingles.words(t))) for k, t in rows]
    links = om.tile_links(tile, tile, True, 0.8)
    assert len(links) < len(rows)
    assert len({k for k in brute_classes(rows).values()}) == len(rows) - len(links)
