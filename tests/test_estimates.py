"""Estimates, forecasts, patterns and models on planted truths and against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import functions as fn
from sparkloom.operators import contracts, estimates, forecasting, graphs, models, patterns, preflight, structure


def table(spark, columns: dict):
    names = list(columns)
    return spark.createDataFrame([tuple(v.item() if hasattr(v, "item") else v for v in row) for row in zip(*columns.values(), strict=True)], names)


def test_tails(spark):
    df = spark.createDataFrame([(z,) for z in (0.0, 0.5, 1.96, 3.0, -2.0)], "z double")
    for r in df.select("z", fn.normal_tail(F.col("z")).alias("p"), fn.chi2_tail(F.col("z") ** 2, 1).alias("c"), fn.chi2_tail(F.col("z") ** 2, 4).alias("f")).collect():
        assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), abs=1e-6) and r.c == pytest.approx(r.p, abs=1e-6)
        assert r.f == pytest.approx(math.exp(-(r.z**2) / 2) * (1 + r.z**2 / 2))


@pytest.mark.parametrize("few", [10**9, 0])
def test_running_sums_and_quantiles_by_slices(spark, monkeypatch, few):
    monkeypatch.setattr(estimates, "FEW", few)
    rng = np.random.default_rng(1)
    x = rng.permutation(500).astype(float)
    df = table(spark, {"x": x, "v": np.round(rng.normal(size=500), 6)})
    rows = sorted(tuple(r) for r in df.collect())
    got = {r.x: (r.up, r.low) for r in estimates.running(df, "x", {"up": "v"}, {"low": "v"}).collect()}
    down = {r.x: r.up for r in estimates.running(df, "x", {"up": "v"}, descending=True).collect()}
    for i, (k, _) in enumerate(rows):
        assert got[k] == pytest.approx((sum(v for _, v in rows[: i + 1]), min(v for _, v in rows[: i + 1])))
        assert down[k] == pytest.approx(sum(v for _, v in rows[i:]))
    assert estimates.quantiles(df, "v", [0.1, 0.5, 0.77]) == pytest.approx(np.quantile([v for _, v in rows], [0.1, 0.5, 0.77]).tolist())


def test_corrections(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5, 0.03]
    got = {r.i: (r.q, r.bonferroni) for r in estimates.corrected(table(spark, {"i": range(6), "p": p}), "p").collect()}
    order = sorted(range(6), key=lambda i: p[i])
    q, least = {}, 1.0
    for rank in range(6, 0, -1):
        least = min(least, p[order[rank - 1]] * 6 / rank)
        q[order[rank - 1]] = least
    assert all(got[i] == pytest.approx((q[i], min(1.0, p[i] * 6))) for i in range(6))


def test_cox_finds_a_hazard(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, 800)
    t = np.ceil(rng.exponential(10 / np.exp(0.8 * x)))
    df = table(spark, {"t": t, "e": (rng.random(800) < 0.9).astype(int), "x": x})
    got = estimates.cox(df, "t", F.col("e") == 1, ["x"]).first()
    rows = [tuple(r) for r in df.collect()]
    def slope(b):
        out = 0.0
        for time in {r[0] for r in rows if r[1]}:
            dead, risk = [r for r in rows if r[0] == time and r[1]], [r for r in rows if r[0] >= time]
            w = [math.exp(b * r[2]) for r in risk]
            out += sum(r[2] for r in dead) - len(dead) * sum(a * r[2] for a, r in zip(w, risk, strict=True)) / sum(w)
        return out
    assert 0.5 < got.coefficient < 1.1 and got.p < 0.01 and abs(slope(got.coefficient)) < 1e-3


def test_treatment_effect_undoes_confounding(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=3000)
    t = (rng.random(3000) < 1 / (1 + np.exp(-x))).astype(int)
    df = table(spark, {"t": t, "y": 2 * t + 3 * x + rng.normal(size=3000), "x": x})
    got = {r.method: r.effect for r in estimates.treatment_effect(df, "t", "y", ["x"]).collect()}
    assert got["plain"] > 3 and abs(got["doubly_robust"] - 2) < 0.2 and abs(got["ipw"] - 2) < 0.4


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(4)
    p = np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(60, 0.1, (40, 2)), [[500.0, 500.0]]])
    df = table(spark, {"k": range(len(p)), "x": p[:, 0], "y": p[:, 1]})
    got = {}
    for r in estimates.neighbours(df, "k", "x", "y", 5).collect():
        got.setdefault(r.key, []).append((round(r.distance, 9), r.other))
    for i in range(len(p)):
        d = sorted((round(float(np.hypot(*(p[i] - p[j]))), 9), j) for j in range(len(p)) if j != i)[:5]
        assert sorted(got[i]) == d


def test_spatial_clusters_are_seen(spark):
    g = [(i, float(i % 15), float(i // 15), float((i % 15) // 5 + np.sin(i))) for i in range(225)]
    got = estimates.spatial(spark.createDataFrame(g, "k int, x double, y double, v double"), "k", "x", "y", "v").first()
    assert got.moran > 0.2 and got.p < 0.001 and got.geary < 1


def test_bootstrap_covers(spark):
    rng = np.random.default_rng(5)
    df = table(spark, {"k": range(4000), "v": rng.normal(10, 2, 4000)})
    got = estimates.bootstrap(df, F.col("k"), {"n": F.lit(1), "s": F.col("v")}, lambda c: c("s") / c("n")).first()
    assert got.low < 10.1 and got.high > 9.9 and 0.02 < got.sd < 0.05


def test_change_points():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=100), rng.normal(5, 1, 100)])
    assert 100 <= patterns.cusum_points(x)["at"][0] <= 110
    assert patterns.pelt_points(x)["start"].tolist() == [0, 100]
    b = patterns.bayes_points(x)
    assert 100 <= b["at"][b["probability"].argmax()] <= 106
    regimes = patterns.hidden_regimes(x, (2, 3))["regime"].to_numpy()
    assert (regimes[:95] < regimes[105]).mean() > 0.9


def test_pruned_search_is_exact():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(m, 1, 12) for m in (0, 4, -3)])
    z, beta = (x - x.mean()) / x.std(), 2.0
    cost = lambda a, b: ((z[a:b] - z[a:b].mean()) ** 2).sum()
    best = {0: (-beta, [])}
    for t in range(2, len(z) + 1):
        best[t] = min((best[s][0] + cost(s, t) + beta, best[s][1] + [s]) for s in best if t - s >= 2)
    assert patterns.pelt_points(x, beta)["start"].tolist() == best[len(z)][1]


def test_decompositions_add_up():
    t = np.arange(140)
    x = 0.1 * t + 3 * np.sin(2 * np.pi * t / 7) + np.sin(2 * np.pi * t / 40)
    s = patterns.seasonal_parts(x)
    assert np.allclose(s["trend"] + s["season"] + s["rest"], x) and s["season"].std() > 1.5
    modes = patterns.intrinsic_modes(x)
    assert np.allclose(modes.groupby("at")["value"].sum(), x) and modes["mode"].max() >= 1
    low, sparse = patterns.low_rank_and_sparse(np.outer(np.arange(1, 21), np.ones(10)) + np.eye(20, 10) * 50)
    assert np.linalg.matrix_rank(low, tol=1) == 1 and (np.abs(sparse) > 25).sum() == 10


def test_motifs_warping_waves_and_analogs():
    rng = np.random.default_rng(8)
    x = rng.normal(size=300)
    x[200:220] = x[40:60]
    m = patterns.motifs(x, 20)
    assert {m["at"][0], m["other"][0]} == {40, 200} and set(m["kind"]) == {"motif", "discord"}
    a = np.sin(np.arange(60) / 5)
    w = patterns.warped(a, np.sin(np.arange(60) / 5 + 0.4)).iloc[0]
    assert w["bound"] <= w["distance"] < np.linalg.norm(a - np.sin(np.arange(60) / 5 + 0.4))
    waves = patterns.ridge_of_waves(np.sin(2 * np.pi * np.arange(256) / 16))
    assert 12 < waves["period"][100:150].median() < 21
    f = patterns.analog_forecast(np.tile([1.0, 2.0, 5.0, 3.0], 20), 8, 3, 4)
    assert f["value"].tolist() == pytest.approx([1.0, 2.0, 5.0, 3.0])
    flat = patterns.simulated_bands(rng.normal(size=400))
    assert (flat["p05"] < flat["p50"]).all() and (flat["p50"] < flat["p95"]).all()


def test_laws_and_information():
    t = np.arange(40, dtype=float)
    assert patterns.physics_forms(t, 5 * np.exp(0.1 * (t + 1))).iloc[0]["form"] == "exponential"
    assert patterns.physics_forms(t, 3 * (t + 1) ** 1.7).iloc[0]["form"] == "power"
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=800), rng.normal(size=800)
    z = 0.9 * x + math.sqrt(1 - 0.81) * y
    assert patterns.nearest_information(x, y)["mi"][0] < 0.08
    assert abs(patterns.nearest_information(x, z)["mi"][0] + 0.5 * math.log(1 - 0.81)) < 0.12


def test_a_long_series_is_refused(spark, monkeypatch):
    monkeypatch.setattr(patterns, "LONGEST", 5)
    df = spark.range(9).select(F.lit("k").alias("k"), "id", F.col("id").cast("double").alias("v"))
    with pytest.raises(Exception, match="more than 5"):
        patterns.each_series(df, ["k"], ["id"], ["v"], patterns.smoothed, "at long, level double, low double, high double").collect()


def test_forecasts_follow_a_season(spark):
    df = spark.createDataFrame([("s", i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 9.0][i % 7]) for i in range(70)], "k string, i int, x double")
    got = {r.h: (r.method, r.value) for r in forecasting.chosen(df, ["k"], ["i"], "x", 7).collect()}
    assert got[1] == ("seasonal", 1.0) and got[7] == ("seasonal", 9.0)
    assert forecasting.chosen(df.limit(0), ["k"], ["i"], "x", 7).count() == 0


def test_outliers_and_clusters(spark):
    rng = np.random.default_rng(10)
    p = np.concatenate([rng.normal(0, 1, (200, 2)), rng.normal(12, 1, (100, 2)), [[40.0, -40.0]]])
    df = table(spark, {"k": range(301), "x": p[:, 0], "y": p[:, 1]})
    assert models.isolation_scores(df, "k", ["x", "y"]).orderBy(F.desc("score")).first().key == 300
    assert models.local_outliers(df, "k", "x", "y", 10).orderBy(F.desc("lof")).first().key == 300
    found, k = models.clusters(df.where("k < 300"), "k", ["x", "y"])
    sizes = sorted(r["count"] for r in found.groupBy("cluster").count().collect())
    assert k == 2 and sizes == [100, 200]


def test_graph_figures(spark):
    edges = [(a, b) for g in (0, 10) for a in range(g, g + 5) for b in range(a + 1, g + 5)] + [(0, 10)]
    df = spark.createDataFrame(edges, "a int, b int")
    got = {r.node: r.betweenness for r in graphs.betweenness(df).collect()}
    assert got[0] == got[10] == 4 * 5 and got[1] == 0
    groups = {}
    for r in graphs.louvain(df)[0].collect():
        groups.setdefault(r.community, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [list(range(5)), list(range(10, 15))]
    points = spark.createDataFrame([(i, float(i % 10 + (i // 10) * 100), 0.0) for i in range(30)], "k int, x double, y double")
    assert graphs.components_born_and_dead(points, "k", ["x", "y"]).where("death IS NULL OR death > 1").count() == 3


def test_field_of_heat(spark):
    grid = [(t, x, math.exp(-0.09 * t * 0.1) * math.sin(0.3 * x) + math.exp(-0.25 * t * 0.1) * math.sin(0.5 * x)) for t in range(30) for x in range(30)]
    got = {r.law: r for r in models.field_laws(spark.createDataFrame(grid, "t int, x int, u double"), "t", "x", "u", 0.1, 1.0).collect()}
    assert got["heat"].r2 > 0.99 and got["heat"].coefficient == pytest.approx(1.0, abs=0.05) and got["advection"].r2 < 0.5


def test_dynamics_are_found(spark):
    x, rows = np.array([1.0, 0.5]), []
    for i in range(200):
        rows.append(("s", i, float(x[0]), float(x[1])))
        x = x + np.array([0.1 * x[1], -0.1 * x[0]])
    got = {(r.state, r.term): r.coefficient for r in models.dynamics(spark.createDataFrame(rows, "k string, i int, a double, b double"), ["k"], ["i"], ["a", "b"]).collect()}
    assert ("a", "b") in got and ("b", "a") in got and got["a", "b"] > 0 > got["b", "a"]


def test_false_fires_grow_with_memory(spark):
    got = {r.phi: r.rate for r in models.false_fires(spark, [(0.0, 90), (0.8, 90)], 60).collect()}
    assert got[0.0] < got[0.8]


def test_missing_values_in_slices(spark):
    df = spark.range(2000).select("id", F.expr("IF(id BETWEEN 95 AND 130 OR id BETWEEN 1500 AND 1540, NULL, 1.0)").alias("v"))
    rows = preflight.numbered(df, ["id"])
    assert [r.pos for r in rows.orderBy("id").collect()] == list(range(2000))
    got = {(r["first"], r["last"]) for r in preflight.runs(rows.where("v IS NULL").select(F.lit("v").alias("c"), "pos"), ["c"], slice_rows=100).collect()}
    assert got == {(95, 130), (1500, 1540)}
    empty = preflight.missingness(df.limit(0), ["v"], ["id"])
    assert empty.count() == 0


def test_predicates(spark):
    df = spark.createDataFrame([(5.0, "12", ["a"]), (None, None, None)], "n double, s string, l array<string>")
    cases = [("n", "number", ">", 4, True), ("s", "text", ">", 4, True), ("n", "number", "==", "5", False), ("n", "number", "in", [5.0], True), ("s", "text", "regex", "^1", True), ("n", "number", "regex", "5", False), ("l", "list", "contains", "a", True), ("n", "number", "!=", 5.0, False), ("s", "text", "not_in", ["12"], False)]
    first, second = df.select(*[contracts.predicate(F.col(c), k, op, x).alias(f"c{i}") for i, (c, k, op, x, _) in enumerate(cases)]).collect()
    assert list(first) == [want for *_, want in cases]
    assert [second[f"c{i}"] for i, c in enumerate(cases) if c[2] not in ("!=", "not_in")] == [False] * 7


def test_log_ratios(spark):
    df = spark.createDataFrame([(0.2, 0.3, 0.5), (0.1, 0.1, 0.8)], "a double, b double, c double")
    got = structure.compositional(df, ["a", "b", "c"]).first()
    logs = np.log([[0.2, 0.3, 0.5], [0.1, 0.1, 0.8]])
    assert got.is_compositional and got.clr_a == pytest.approx((logs - logs.mean(axis=1, keepdims=True))[:, 0].mean())
    assert got.ilr_1 == pytest.approx(((logs[:, 0] - logs[:, 1]) / math.sqrt(2)).mean())
