"""Derived features, rows that stand out, steady clusters, proportional hazards and numbered texts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import estimates, features, preflight


def test_derived_counts_equal_pandas(spark):
    import pandas as pd

    rows = [(1, 0, 5.0, 1.0), (1, 1, None, 0.0), (1, 2, 9.0, 2.0), (1, 3, 50.0, None), (2, 0, 7.0, 3.0), (2, 1, 7.0, 0.0)]
    df = spark.createDataFrame(rows, "k int, i int, a double, b double")
    got = {r["feature"]: r for r in features.derived(df, ["k"], ["i"], ["a", "b"]).collect()}
    p = pd.DataFrame(rows, columns=["k", "i", "a", "b"])
    for c in "ab":
        g = p.groupby("k")[c]
        d1 = g.diff()
        assert got[f"{c}__d1"]["non_null"] == d1.notna().sum()
        assert got[f"{c}__d2"]["non_null"] == d1.groupby(p["k"]).diff().notna().sum()
        assert got[f"{c}__lag1"]["non_null"] == g.shift(1).notna().sum()
        assert (got[f"{c}__z"]["mean"], got[f"{c}__z"]["sd"]) == pytest.approx((p[c].mean(), p[c].std()))
    # a varies more: it stands above, where b is 0 or a null the ratio is null
    assert got["a__over__b"]["non_null"] == 3 and len(got) == 9
    assert len(features.derived(df, ["k"], ["i"], ["a", "b"], most=1).collect()) == 4


def test_contributors_of_a_planted_row(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(x), float(y), 1.0) for i, (x, y) in enumerate(rng.normal(size=(200, 2)))]
    rows += [(900, 1.0, 50.0, 1.0), (901, None, -30.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double, same double")
    got = features.contributors(df, "id", ["x", "y", "same"], most=2, parts=2).orderBy(F.desc("score"), "place").collect()
    assert [(r["key"], r["place"], r["column"]) for r in got] == [(900, 1, "y"), (900, 2, "x"), (901, 1, "y"), (901, 2, "same")]
    y = np.array([r[2] for r in rows])
    assert got[0]["z"] == pytest.approx(0.6745 * abs(50 - np.median(y)) / np.median(abs(y - np.median(y))))
    assert got[3]["z"] == 0.0


def test_stability_tells_clusters_from_noise(spark):
    rng = np.random.default_rng(2)
    centres = np.array([[0, 0], [20, 0], [0, 20]])
    near = centres[rng.integers(0, 3, 240)] + rng.normal(size=(240, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(near)], "id long, x double, y double")
    told = features.stability(df, "id", ["x", "y"], 3, resamples=3)
    assert told["verdict"] == "strong" and told["stability"] > 0.99
    noise = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(size=(240, 2)))], "id long, x double, y double")
    assert features.stability(noise, "id", ["x", "y"], 7, resamples=3)["stability"] < told["stability"] - 0.2
    assert features.stability(df.limit(10), "id", ["x", "y"], 3)["verdict"] == "too few rows"


def plain_residuals(time, event, x, beta):
    d, r = [], []
    for i in range(len(time)):
        if event[i]:
            risk = time >= time[i]
            w = np.exp(beta * x[risk])
            d.append(time[i])
            r.append(x[i] - (w * x[risk]).sum() / w.sum())
    d, r = np.array(d), np.array(r)
    rank = np.array([(d < t).sum() + ((d == t).sum() - 1) / 2 for t in d])
    moved = ((r - r.mean()) * (rank - rank.mean())).sum()
    return moved**2 / (((rank - rank.mean()) ** 2).sum() * r.var(ddof=1))


def test_proportional_hazards_and_a_planted_crossing(spark):
    rng = np.random.default_rng(11)
    n = 400
    x = rng.integers(0, 2, n).astype(float)
    steady = rng.exponential(1 / np.exp(0.7 * x))
    # an effect that turns round: early for x = 1, late for x = 0
    crossing = np.where(x == 1, rng.exponential(1.0, n) ** 0.25, rng.exponential(1.0, n) ** 2.5)
    for time, violated in ((np.round(steady, 2), False), (np.round(crossing, 2), True)):
        event = rng.random(n) < 0.8
        rows = [(float(t), bool(e), float(v)) for t, e, v in zip(time, event, x, strict=True)]
        df = spark.createDataFrame(rows, "t double, e boolean, x double")
        beta = estimates.cox(df, "t", F.col("e"), ["x"]).first()["coefficient"]
        got = estimates.proportional(df, "t", F.col("e"), ["x"], [beta]).first()
        assert got["chi2"] == pytest.approx(plain_residuals(time, event, x, beta), rel=1e-6, abs=1e-9)
        assert got["violated"] == violated and got["n"] == event.sum()
    assert estimates.proportional(df.limit(4), "t", F.lit(True), ["x"], [0.0]).count() == 0


def test_texts_are_numbered_in_their_order(spark):
    names = [f"{a}{b}é{c}" for a in "bÄaz" for b in ("", "long prefix ") for c in range(40)] + ["", None]
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(4)
    got = [r["name"] for r in preflight.numbered(df, ["name"], parts=8).orderBy("pos").collect()]
    assert got == [r["name"] for r in df.orderBy("name").collect()]
