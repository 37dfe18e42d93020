"""Adjustment on graphs against an enumeration of paths, effects on planted truths, autoregressions against plain least squares."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import adjustment, autoregression, slices


def edges_of(spark, arcs):
    return spark.createDataFrame([(a, b, w) for a, b, w in ((*x, 1.0)[:3] for x in arcs)], "source string, target string, weight double")


def plain_separated(arcs, a, b, given):
    """By all paths of the graph."""
    arcs = {(x, y) for x, y, *_ in arcs}
    nodes = {n for e in arcs for n in e}
    below = {n: {n} for n in nodes}
    for _ in nodes:
        for x, y in arcs:
            below[x] |= below[y]

    def paths(path):
        if path[-1] == b:
            yield path
            return
        for n in nodes - set(path):
            if (path[-1], n) in arcs or (n, path[-1]) in arcs:
                yield from paths([*path, n])

    def open_(path):
        for x, y, z in zip(path, path[1:], path[2:], strict=False):
            collider = (x, y) in arcs and (z, y) in arcs
            if collider and not below[y] & set(given) or not collider and y in given:
                return False
        return True

    return not any(open_(p) for p in paths([a]))


def test_separation_agrees_with_paths(spark):
    rng = random.Random(1)
    for _ in range(4):
        names = list("abcde")
        arcs = [(x, y) for x, y in itertools.combinations(names, 2) if rng.random() < 0.45] or [("a", "b")]
        df = edges_of(spark, arcs).cache()
        used = sorted({n for e in arcs for n in e})
        for given in ([], [rng.choice(used)]):
            a = next(n for n in used if n not in given)
            got = {r.node for r in adjustment.connected(df, a, given).collect()}
            assert got == {n for n in used if n != a and n not in given and not plain_separated(arcs, a, n, given)}, (arcs, a, given)


CONFOUNDED = [("z", "t"), ("z", "y"), ("t", "y")]


def confounded(n=800, effect=0.4, seed=42):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=n)
    t = 0.7 * z + rng.normal(size=n) * 0.5
    return pd.DataFrame({"row": np.arange(n), "z": z, "t": t, "y": effect * t + 0.6 * z + rng.normal(size=n) * 0.4})


def test_adjustment_sets(spark):
    df = edges_of(spark, CONFOUNDED)
    assert adjustment.adjustment_set(df, "t", "y") == ("IDENTIFIED", ["z"])
    assert adjustment.adjustment_set(df, "ghost", "y") == ("UNKNOWN_NODE", [])
    assert adjustment.adjustment_set(edges_of(spark, [("t", "y")]), "t", "y") == ("IDENTIFIED", [])
    assert adjustment.adjustment_set(df, "y", "t") == ("UNIDENTIFIABLE", [])
    # a parent that is hidden from the outcome's side needs no more than the parents
    assert adjustment.adjustment_set(edges_of(spark, [("u", "z"), ("u", "y"), ("z", "t"), ("t", "m"), ("m", "y")]), "t", "y") == ("IDENTIFIED", ["z"])
    alone = spark.createDataFrame([("t",), ("y",)], "node string")
    assert adjustment.adjustment_set(df.limit(0), "t", "y", alone) == ("IDENTIFIED", [])


def test_weakest_edge_of_each_cycle_is_dropped(spark):
    left, dropped = adjustment.acyclic(edges_of(spark, [("a", "b", 0.9), ("b", "a", 0.2), ("b", "c", 0.1), ("c", "d", 0.8), ("d", "e", 0.3), ("e", "c", 0.7), ("e", "e", 0.01)]))
    assert [(r.source, r.target) for r in dropped.collect()] == [("b", "a"), ("d", "e")]
    assert {(r.source, r.target) for r in left.collect()} == {("a", "b"), ("b", "c"), ("c", "d"), ("e", "c")}
    none, gone = adjustment.acyclic(edges_of(spark, [("a", "b")]).limit(0))
    assert none.count() == gone.count() == 0


def test_effect_and_counterfactual_of_a_planted_truth(spark):
    data = confounded()
    df, arcs = spark.createDataFrame(data), edges_of(spark, CONFOUNDED)
    got = adjustment.effect(df, arcs, "t", "y", 1.0).first()
    x = np.column_stack([np.ones(800), data.t, data.z])
    beta = np.linalg.lstsq(x, data.y, rcond=None)[0]
    assert (got.status, got.adjustment, got.n) == ("IDENTIFIED", ["z"], 800)
    assert got.effect == pytest.approx(beta[1], rel=1e-9) and abs(got.effect - 0.4) < 0.1 and 0 < got.se < 0.1
    assert got.predicted == pytest.approx(data.y.mean() + beta[1] * (1 - data.t.mean()))
    rows = adjustment.counterfactual(df, arcs, "t", "y", F.col("t") + 1).where("row = 10").first()
    assert rows.delta == pytest.approx(beta[1]) and rows.cf_outcome == pytest.approx(data.y[10] + beta[1]) and rows.cf_treatment == pytest.approx(data.t[10] + 1)
    mean = adjustment.mean_counterfactual(df, arcs, "t", "y", 2.0).first()
    assert mean.cf_outcome == pytest.approx(data.y.mean() + beta[1] * (2 - data.t.mean()))
    few = adjustment.effect(df.limit(5), arcs, "t", "y").first()
    assert (few.status, few.n, few.effect) == ("TOO_FEW_ROWS", 5, None)
    assert adjustment.effect(df, arcs, "y", "t").first().status == "UNIDENTIFIABLE"


def system(n=400, seed=3):
    rng = np.random.default_rng(seed)
    a = np.array([[[0.5, 0.0, 0.3], [0.0, 0.4, 0.0], [0.0, 0.6, 0.2]], [[0.0, 0.0, 0.0], [0.3, 0.0, 0.0], [0.0, 0.0, -0.3]]])
    x = np.zeros((n, 3))
    for t in range(2, n):
        x[t] = np.array([1.0, 2.0, 100.0]) + a[0] @ x[t - 1] + a[1] @ x[t - 2] + rng.normal(size=3)
    return x[50:]


def frame_of(spark, x, key="s"):
    return spark.createDataFrame(pd.DataFrame({"k": key, "t": np.arange(len(x)), **{f"c{i}": x[:, i] for i in range(x.shape[1])}})).repartition(5)


COLUMNS = ["c0", "c1", "c2"]


def design(x, p, skip=None):
    skip = p if skip is None else skip
    return np.column_stack([np.ones(len(x) - skip), *[x[skip - i : len(x) - i] for i in range(1, p + 1)]]), x[skip:]


def test_vector_autoregression_equals_least_squares(spark):
    x = system()
    df = frame_of(spark, x)
    fits, forecasts = autoregression.vector_autoregression(df, ["k"], ["t"], COLUMNS, most=6, horizon=5, width=60)
    told = fits.first()
    aic = []
    for p in range(7):
        z, y = design(x, p, 6)
        left = y - z @ np.linalg.lstsq(z, y, rcond=None)[0]
        aic.append(np.linalg.slogdet(left.T @ left / len(y))[1] + 2 / len(y) * (9 * p + 3))
    assert told.order == max(1, int(np.argmin(aic))) == 2 and told.n == len(x) - 2
    z, y = design(x, 2)
    beta = np.linalg.lstsq(z, y, rcond=None)[0].T
    assert np.allclose(told.coefficients, beta, rtol=1e-6, atol=1e-6)
    assert (told.source, told.target) == ("c1", "c2") and told.coupling == pytest.approx(beta[2][2])
    past = list(x)
    for _ in range(5):
        past.append(beta @ np.concatenate(([1.0], past[-1], past[-2])))
    got = {(r.h, r.column): r.value for r in forecasts.collect()}
    assert all(got[h, c] == pytest.approx(past[len(x) + h - 1][i], rel=1e-7) for h in range(1, 6) for i, c in enumerate(COLUMNS)) and len(got) == 15


def test_series_of_different_lengths_and_short_ones(spark):
    df = frame_of(spark, system(), "long").unionByName(frame_of(spark, system(90, 4), "short")).unionByName(frame_of(spark, system(70, 5), "none"))
    fits, forecasts = autoregression.vector_autoregression(df, ["k"], ["t"], COLUMNS, most=3, horizon=2, width=50)
    assert {r.k for r in fits.collect()} == {"long", "short"} and forecasts.count() == 12
    none = autoregression.vector_autoregression(df.limit(0), ["k"], ["t"], COLUMNS)
    assert none[0].count() == none[1].count() == 0


def test_granger_equals_two_regressions(spark):
    x = system()
    got = {(r.cause, r.effect, r.lag): r for r in autoregression.granger(frame_of(spark, x), ["k"], ["t"], COLUMNS, 3, width=70).collect()}
    assert len(got) == 18
    for (cause, effect, lag), r in got.items():
        i, j = COLUMNS.index(cause), COLUMNS.index(effect)
        y = x[3:, j]
        own = np.column_stack([np.ones(len(y)), *[x[3 - g : len(x) - g, j] for g in range(1, lag + 1)]])
        both = np.column_stack([own, *[x[3 - g : len(x) - g, i] for g in range(1, lag + 1)]])
        rss = [float(((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum()) for m in (own, both)]
        assert r.f == pytest.approx((rss[0] - rss[1]) / lag / (rss[1] / (len(y) - 2 * lag - 1)), rel=1e-5)
    assert got["c1", "c2", 1].p < 1e-6 and got["c2", "c1", 1].p > 1e-3


def test_tail_of_f():
    for f, b in ((0.5, 7), (3.0, 40), (12.0, 11)):
        assert autoregression.f_tail(f, 2, b) == pytest.approx((1 + 2 * f / b) ** (-b / 2), rel=1e-9)
    assert autoregression.f_tail(1.0, 9, 9) == pytest.approx(0.5)
    assert autoregression.f_tail(4.0, 1, 1) == pytest.approx(2 / math.pi * math.atan(1 / 2), rel=1e-9)
    assert autoregression.f_tail(0.0, 3, 5) == 1.0


def test_transfer_entropy_of_a_follower(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=600)
    y = np.concatenate(([0.0], x[:-1])) + rng.normal(size=600) * 0.1
    df = frame_of(spark, np.column_stack([x, y]))
    got = {(r.cause, r.effect): r.te for r in autoregression.transfer_entropy(df, ["k"], ["t"], ["c0", "c1"], width=100).collect()}

    def plain(cause, effect):
        bins = lambda v: np.minimum(5, np.floor((v - v.min()) / (v.max() - v.min()) * 6)).astype(int)
        cells = list(zip(bins(cause[:-1]), bins(effect[1:]), bins(effect[:-1]), strict=True))
        n = lambda k: {c: sum(1 for d in cells if k(d) == c) for c in set(map(k, cells))}
        xyz, xz, yz, z = n(lambda d: d), n(lambda d: (d[0], d[2])), n(lambda d: (d[1], d[2])), n(lambda d: d[2])
        return sum(m / len(cells) * math.log(m * z[c[2]] / (xz[c[0], c[2]] * yz[c[1], c[2]])) for c, m in xyz.items())

    assert got["c0", "c1"] == pytest.approx(plain(x, y)) and got["c1", "c0"] == pytest.approx(plain(y, x))
    assert got["c0", "c1"] > 0.8 > 0.3 > got["c1", "c0"]


def test_gram_is_that_of_the_whole_series(spark):
    x = system(200)
    g = autoregression.gram(slices.numbered(frame_of(spark, x), ["k"], ["t"], COLUMNS), ["k"], 2, width=7).first()
    z = x - x.mean(axis=0)
    w = np.column_stack([np.ones(len(x) - 2), z[:-2], z[1:-1], z[2:]])
    assert g.n == len(x) - 2 and np.allclose(np.reshape(g.g, (10, 10)), w.T @ w)
