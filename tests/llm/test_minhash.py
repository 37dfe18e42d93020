from __future__ import annotations

import random
import re

import pytest

from sparkloom.llm import minhash
from sparkloom.llm.minhash import deduplicated, near_duplicates


def sets_of(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows, size, percent):
    sets = [(i, sets_of(t, size)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=str)


def cases():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, k = [], 100
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 10, 60, 200, 500]))]
        for rate in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08):
            rows.append((k, " ".join(x if rng.random() > rate else f"n{rng.randint(0, 10**6)}" for x in base)))
            k += 1
    return rows + [(1, ""), (2, None), (3, "a"), (4, "A"), (5, "a b"), (6, "a b c"), (7, "A  b\tc"), (None, "a b c"), (None, None), (8, " \n"), (100, rows[0][1]), (9, "É a b"), (10, "é a b")]


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_matches_brute_force(spark, size, percent):
    rows = cases()
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, node int")
    got = near_duplicates(df, size, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == brute(rows, size, percent)


def test_ids_with_several_texts(spark):
    """A text that is near either text of an id is in its component."""
    rng = random.Random(11)
    a, b = (" ".join(rng.choice("abcdefghijklmnop") + str(rng.randint(0, 99)) for _ in range(200)) for _ in range(2))
    rows = [(5, a), (5, b), (7, b + " more"), (9, a + " more"), (5, "else"), (11, "else"), (3, b + " other"), (20, "apart")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == brute(rows, 3, 85)
    assert {r.component_id for r in got} == {3, 20}


def test_blocks_of_large_groups_agree(spark, monkeypatch):
    """A family that is dealt out over pairs of blocks gives the same components."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 300)
    rows = [r for r in cases() if r[0] is not None][:60]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == brute(rows, 3, 85)


def test_one_of_each_group_stays(spark):
    df = spark.createDataFrame([(3, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "other words are here now", "z"), (None, None, "n")], "doc_id long, text string, extra string")
    assert {(r.doc_id, r.extra) for r in deduplicated(df).collect()} == {(1, "y"), (2, "z"), (None, "n")}


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
