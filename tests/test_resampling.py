"""Resampling by cluster against plain versions and planted nulls."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import resampling


def test_weights_have_their_distributions():
    w = resampling.weights(np.arange(2000), np.arange(1, 201), 7, "poisson")
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and w.max() >= 5
    s = resampling.weights(np.arange(2000), np.arange(1, 201), 7, "sign")
    assert set(np.unique(s)) == {-1.0, 1.0} and abs(s.mean()) < 0.01
    assert abs(np.corrcoef(s[:, 0], s[:, 1])[0, 1]) < 0.1 and abs(np.corrcoef(s[0], s[1])[0, 1]) < 0.3


def test_replicate_sums_are_those_of_the_weights(spark):
    rows = [(i % 7, "ab"[i % 2], float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "c int, g string, v double").repartition(5)
    hashes = {r.c: r.h for r in df.select("c", F.xxhash64("c").alias("h")).distinct().collect()}
    w = {c: resampling.weights(np.array([h]), np.arange(1, 31), 3, "poisson")[0] for c, h in hashes.items()}
    got = {(r.replicate, r.by): r.v for r in resampling.replicate_sums(df, F.col("c"), {"v": F.col("v")}, 30, 3, by=F.col("g")).collect()}
    assert len(got) == 60
    for (b, g), v in got.items():
        assert v == pytest.approx(sum(w[c][b - 1] * x for c, k, x in rows if k == g))


def test_bca_of_a_skewed_mean(spark):
    x = np.random.default_rng(1).exponential(size=400)
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(400), "v": x}))
    got = resampling.bca(df, F.col("i"), {"s": F.col("v"), "n": F.lit(1)}, lambda c: c("s") / c("n"), 2000).first()
    rng = np.random.default_rng(2)
    drawn = np.sort([rng.choice(x, 400).mean() for _ in range(4000)])
    assert got.estimate == pytest.approx(x.mean()) and got.n_replicates == 2000
    # skewed to the right: both ends lie above those of the plain percentiles, and near them
    plain = np.quantile(drawn, [0.025, 0.975])
    se = drawn.std()
    assert plain[0] - 0.1 * se < got.low < plain[0] + 0.5 * se and plain[1] - 0.1 * se < got.high < plain[1] + 0.6 * se
    assert resampling.bca(df.limit(0), F.col("i"), {"s": F.col("v"), "n": F.lit(1)}, lambda c: c("s") / c("n")).first().estimate is None


def panel(seed, effect=0.0, entities=40, times=8, trend=0.0):
    rng = np.random.default_rng(seed)
    e, t = np.meshgrid(np.arange(entities), np.arange(times), indexing="ij")
    treated = ((e % 2 == 1) & (t >= 4)).astype(int)
    y = rng.normal(size=entities)[:, None] + rng.normal(size=times)[None] + effect * treated + trend * (e % 2) * t + np.cumsum(rng.normal(size=(entities, times)) * 0.5, axis=1)
    return pd.DataFrame({"e": e.ravel(), "t": t.ravel(), "d": treated.ravel(), "y": y.ravel()})


def test_wild_cluster_of_planted_effects(spark):
    strong = resampling.wild_cluster(spark.createDataFrame(panel(1, 3.0)), "e", "t", "d", "y").first()
    assert abs(strong.effect - 3) < 0.7 and strong.p <= 0.005 and strong.entities == 40 and strong.n == 320 and strong.pretrend_p > 0.05
    bent = resampling.wild_cluster(spark.createDataFrame(panel(1, 0.0, trend=2.0)), "e", "t", "d", "y").first()
    assert abs(bent.pretrend - 2) < 0.5 and bent.pretrend_p < 0.01
    none = resampling.wild_cluster(spark.createDataFrame(panel(2)).withColumn("d", F.lit(0)), "e", "t", "d", "y").first()
    assert none.effect is None and none.n == 320


def test_wild_cluster_rejects_at_its_level():
    """Of the null panels about a tenth have a p-value of at most a tenth (the signs' arithmetic alone)."""
    small = 0
    for seed in range(200):
        f = panel(100 + seed)
        x, y = (f.pivot(index="e", columns="t", values=c).to_numpy(float) for c in "dy")
        x, y = (m - m.mean(axis=0) - m.mean(axis=1, keepdims=True) + m.mean() for m in (x, y))
        s = (x * y).sum(axis=1)
        w = resampling.weights(np.arange(40) + 1000 * seed, np.arange(1, 200), 42, "sign")
        small += (1 + (np.abs(w.T @ s) >= abs(s.sum())).sum()) / 200 <= 0.1
    assert 8 <= small <= 34


def test_panel_shares_with_intervals(spark):
    f = panel(3, entities=60)
    got = {r.part: r for r in resampling.panel_share_intervals(spark.createDataFrame(f), "e", "t", "y").collect()}
    y = f.pivot(index="e", columns="t", values="y").to_numpy()
    total = ((y - y.mean()) ** 2).sum()
    share = {"entity": 8 * ((y.mean(axis=1) - y.mean()) ** 2).sum() / total, "time": 60 * ((y.mean(axis=0) - y.mean()) ** 2).sum() / total}
    assert all(got[k].share == pytest.approx(v) for k, v in share.items()) and sum(r.share for r in got.values()) == pytest.approx(1)
    assert all(r.low < r.share < r.high and r.high - r.low < 0.5 for r in got.values())


def test_doubly_robust_interval(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=1500)
    t = (rng.random(1500) < 1 / (1 + np.exp(-z))).astype(int)
    f = pd.DataFrame({"i": np.arange(1500), "z": z, "t": t, "y": 2 * t + z + rng.normal(size=1500)})
    got = resampling.doubly_robust(spark.createDataFrame(f), F.col("i"), "t", "y", ["z"], replicates=400).first()
    assert got.low < 2 < got.high and abs(got.effect - 2) < 0.2 and 0.03 < got.se < 0.12 and got.low < got.effect < got.high


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1025])
def test_permutations_are_permutations(n):
    a, b = (resampling.permuted(n, r, 42, np.arange(n)) for r in (1, 2))
    assert sorted(a) == sorted(b) == list(range(n)) and (n < 7 or (a != b).any())


def test_moran_of_clusters_and_of_noise(spark):
    rng = np.random.default_rng(5)
    xy = rng.random((150, 2)) * 10
    f = pd.DataFrame({"k": np.arange(150), "x": xy[:, 0], "y": xy[:, 1], "near": np.floor(xy[:, 0] / 2.5) + rng.normal(size=150) * 0.1, "noise": rng.normal(size=150)})
    df = spark.createDataFrame(f)
    got = resampling.moran_permutations(df, "k", "x", "y", "near", permutations=199).first()
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    w = np.zeros((150, 150))
    for i in range(150):
        j = np.argsort(d[i])[:8]
        w[i, j] = 1 / d[i, j] / (1 / d[i, j]).sum()
    z = f.near - f.near.mean()
    assert got.moran == pytest.approx(150 / w.sum() * (z.to_numpy() @ w @ z.to_numpy()) / (z**2).sum()) and got.p == 1 / 200 and 0 < got.geary < 1
    noise = resampling.moran_permutations(df, "k", "x", "y", "noise", permutations=199).first()
    assert abs(noise.moran) < 0.2 and noise.p > 0.02
    assert resampling.moran_permutations(df.limit(2), "k", "x", "y", "noise").first().moran is None
