"""Motifs and discords by cells against the whole profile."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from sparkloom.operators import motifs, slices


def series_of(kind, n=3000):
    rng = np.random.default_rng(7)
    x = rng.exponential(50, n).round(2)
    if kind == "walk":
        x = x.cumsum() - 50 * np.arange(n)
    if kind == "copies":  # every row three times in succession: steps and flat windows
        x = np.repeat(x[: n // 3], 3)
    if kind == "repeated":
        x = np.tile(x[: n // 5], 5)
    if kind == "one":
        x[:] = 1.0
    return x


def plain(x, window, most=3):
    """Picked from all pairs; distances by nine decimals, ties to the smaller place."""
    w = np.lib.stride_tricks.sliding_window_view(x, window)
    z = slices._standard(x, window, len(x))
    d = np.array([np.round(np.sqrt(((z - v) ** 2).sum(axis=1)), 9) for v in z])
    d[np.abs(np.arange(len(w))[:, None] - np.arange(len(w))) < max(1, window // 2)] = np.inf
    near = d.argmin(axis=1)
    rows = [(d[i, j], i, j) for i, j in enumerate(near)]
    told = []
    for kind in ("motif", "discord"):
        taken = []
        for far, i, j in sorted(rows, key=lambda r: (r[0] if kind == "motif" else -r[0], *r[1:])):
            spots = (i, j) if kind == "motif" else (i,)
            if len(taken) < most and all(abs(a - b) >= window for a in spots for t in taken for b in t):
                taken.append((i, j) if kind == "motif" else (i,))
                told.append((kind, len(taken), i, j, far))
    return told


@pytest.mark.parametrize("kind", ["even", "walk", "copies", "repeated"])
def test_motifs_by_cells_equal_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(motifs, "SHORT", 0)
    # nothing may be left to the profile of all pairs
    monkeypatch.setattr(slices, "profile", None)
    x, y = series_of(kind), series_of("even", 1200)[::-1].copy()
    rows = pd.concat([pd.DataFrame({"k": k, "t": np.arange(len(v)), "v": v}) for k, v in (("a", x), ("b", y))])
    got = motifs.motifs_and_discords(spark.createDataFrame(rows), ["k"], ["t"], "v", 20, width=700)
    assert got.columns == ["k", "kind", "rank", "at", "other", "distance"]
    for k, v in (("a", x), ("b", y)):
        told = [(r.kind, r.rank, r.at, r.other, r.distance) for r in got.where(f"k = '{k}'").orderBy("kind", "rank", ascending=[False, True]).collect()]
        want = plain(v, 20)
        assert [t[:3] for t in told] == [t[:3] for t in want] and np.allclose([t[4] for t in told], [t[4] for t in want], atol=1e-8)
        assert [t[3] for t in told] == [t[3] for t in want]


def test_what_cells_do_not_settle_goes_by_all_pairs(spark, monkeypatch):
    """All windows of a constant have the first place as their nearest: there is one motif."""
    monkeypatch.setattr(motifs, "SHORT", 500)
    monkeypatch.setattr(motifs, "ROUNDS", 1)
    rows = pd.concat([pd.DataFrame({"k": k, "t": np.arange(len(v)), "v": v}) for k, v in (("one", series_of("one", 600)), ("short", series_of("even", 300)))])
    got = motifs.motifs_and_discords(spark.createDataFrame(rows), ["k"], ["t"], "v", 20, width=200).collect()
    assert sorted((r.kind, r["rank"], r.at, r.other) for r in got if r.k == "one") == [("discord", 1, 0, 10), ("discord", 2, 20, 0), ("discord", 3, 40, 0), ("motif", 1, 0, 10)]
    short = [(r.kind, r["rank"], r.at) for r in got if r.k == "short"]
    assert sorted(short) == sorted(t[:3] for t in plain(series_of("even", 300), 20))
