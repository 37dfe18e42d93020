"""Repeated windows against brute force."""

from __future__ import annotations

import random

import pytest

from sparkloom.llm import census, suffix_dedup
from sparkloom.llm.debruijn import remove_repeated_words
from sparkloom.llm.suffix_dedup import remove_repeated_bytes


def brute(rows, length, words):
    tokens = [(i, (t or "").encode().split() if words else list((t or "").encode())) for i, t in rows]
    first = {}
    for i, t in tokens:
        if i is not None:
            for s in range(len(t) - length + 1):
                k = tuple(t[s : s + length])
                first[k] = min(i, first.get(k, i))
    out = []
    for i, t in tokens:
        gone = [False] * len(t)
        for s in range(len(t) - length + 1 if i is not None else 0):
            if first[tuple(t[s : s + length])] < i:
                gone[s : s + length] = [True] * length
        kept = [x for x, g in zip(t, gone, strict=True) if not g]
        out.append((i, len(t), sum(gone), b" ".join(kept) if words else bytes(kept)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 120))) for _ in range(40)]
    rows = []
    for i in range(120):
        a, b = rng.choice(base), rng.choice(base)
        rows.append((i * 3 % 127, a[: rng.randint(0, 300)] + rng.choice(["", " x ", "\n", "aaaa" * 40]) + b[rng.randint(0, 200) :]))
    return rows + [(5, rows[0][1]), (5, rows[0][1]), (None, rows[1][1]), (None, None), (900, None), (901, ""), (902, " \t"), (903, "ab " * 3000), (904, "ab " * 2000)]


@pytest.mark.parametrize(("length", "words", "remove"), [(50, False, remove_repeated_bytes), (13, True, remove_repeated_words)])
def test_matches_brute_force(spark, length, words, remove):
    rows = cases()
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_removed string")
    got = remove(df).collect()
    assert sorted(((r[0], r[1], r[2], bytes(r["kept"])) for r in got), key=str) == brute(rows, length, words)


def test_empty_table(spark):
    assert remove_repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("length", "words", "remove"), [(50, False, remove_repeated_bytes), (13, True, remove_repeated_words), (24, False, remove_repeated_bytes), (5, True, remove_repeated_words)])
def test_batches_meet(spark, monkeypatch, length, words, remove):
    """Copies that lie in different batches, slices and buckets find each other."""
    monkeypatch.setattr(suffix_dedup, "BUCKET", 5000)
    rows = cases()
    got = remove(spark.createDataFrame(rows, "doc_id long, text string"), length, batch_bytes=3000).collect()
    assert sorted(((r[0], r[1], r[2], bytes(r["kept"])) for r in got), key=str) == brute(rows, length, words)


def test_slices_of_a_batch_find_the_same(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rows = [r for r in cases() if r[0] is not None]
    table = pa.table({"id": pa.array([i for i, _ in rows]), "data": pa.array([None if t is None else t.encode() for _, t in rows])})

    def found():
        b = suffix_dedup._Batch(table, 50)
        return {(p, h) for p, h in zip(*(x.tolist() for x in b.digits()), strict=True)}, sum(b.pieces(b.fits, 7)[1])

    whole = found()
    monkeypatch.setattr(suffix_dedup, "SLICE", 150)
    assert found() == whole and whole[1] == np.sum(suffix_dedup._Batch(table, 50).fits)


@pytest.mark.parametrize(("n", "universe"), [(1, 1 << 10), (700, 1 << 10), (1024, 1 << 10), (5, 1 << 24), (3000, 1 << 20)])
def test_slots_come_back(n, universe):
    import numpy as np

    slots = np.sort(np.random.default_rng(n).choice(universe, n, replace=False)).astype(np.uint32)
    assert (census.decode(census.encode(slots, universe), n, universe) == slots).all()


def test_radix_passes_group_equal_suffixes():
    import numpy as np

    data = "".join(random.Random(5).choice("ab") for _ in range(3000)).encode()
    for length in (12, 16, 21):
        at = np.arange(len(data) - length)
        left, group = suffix_dedup.radix_groups(data, at, length)
        told = {}
        for x, g in zip(left.tolist(), group.tolist(), strict=True):
            told.setdefault(g, set()).add(x)
        want = {}
        for x in at.tolist():
            want.setdefault(data[x : x + length], set()).add(x)
        assert sorted(map(sorted, told.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
