"""Robust covariances and laws on planted truths."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import laws, robust, stats


def test_chi_square():
    assert robust.chi2_below(2.0, 2) == pytest.approx(1 - np.exp(-1), rel=1e-12)
    assert robust.chi2_below(20.0, 4) == pytest.approx(1 - 11 * np.exp(-10), rel=1e-12)
    assert robust.chi2_point(0.975, 2) == pytest.approx(-2 * np.log(0.025), rel=1e-9) and robust.chi2_point(0.95, 1) == pytest.approx(3.841458820694124, rel=1e-9)


def test_masked_outliers_are_found(spark):
    """A far cluster of a quarter of the rows hides in the plain covariance, not in the robust one."""
    rng = np.random.default_rng(1)
    good = rng.multivariate_normal([0, 0, 0], [[1, 0.8, 0.2], [0.8, 1, 0.1], [0.2, 0.1, 1]], 600)
    bad = rng.normal([6, -6, 4], 0.3, (200, 3))
    f = pd.DataFrame(np.concatenate([good, bad]), columns=["a", "b", "c"])
    f["bad"] = np.arange(800) >= 600
    df = spark.createDataFrame(f).repartition(5)
    got = robust.robust_outliers(df, ["a", "b", "c"]).toPandas()
    assert got.loc[got.bad, "outlier"].all() and got.loc[~got.bad, "outlier"].mean() < 0.06
    plain = np.cov(f[["a", "b", "c"]].T)
    dev = f[["a", "b", "c"]] - f[["a", "b", "c"]].mean()
    d = ((dev @ np.linalg.inv(plain)) * dev).sum(axis=1)
    assert (d[f.bad] > robust.chi2_point(0.975, 3)).mean() < 0.5
    centre, cov, n, h = robust.covariance(df, ["a", "b", "c"])
    assert n == 800 and h == 402 and np.abs(centre).max() < 0.15 and np.abs(cov - np.cov(good.T)).max() < 0.3


def test_clean_rows_agree_with_the_plain_covariance(spark):
    rng = np.random.default_rng(2)
    x = rng.multivariate_normal([5, -2], [[4, 1], [1, 2]], 3000)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    centre, cov, _, _ = robust.covariance(df, ["a", "b"], share=0.9)
    assert np.abs(centre - x.mean(axis=0)).max() < 0.15 and np.abs(cov / np.cov(x.T) - 1).max() < 0.25
    few = robust.robust_outliers(df.limit(3), ["a", "b"])
    assert few.count() == 3 and robust.robust_outliers(df.limit(0), ["a", "b"]).count() == 0
    holes = df.limit(50).unionByName(spark.createDataFrame([(None, 1.0)], "a double, b double"))
    assert robust.robust_outliers(holes, ["a", "b"]).where("outlier IS NULL").count() == 1


def test_cut_is_the_hth_value(spark):
    rng = np.random.default_rng(3)
    d = np.exp(rng.normal(size=2000) * 5)
    far = spark.createDataFrame(pd.DataFrame({"d": d}))
    for h in (1, 500, 1999):
        cut = robust._cut(far, h)
        assert h <= (d <= cut).sum() <= h + 2


def simulated(step, x, n, dt=0.01):
    out = [np.array(x, float)]
    for _ in range(n - 1):
        y = out[-1]
        for _ in range(5):  # the midpoint rule
            y = y + dt / 5 * np.array(step(y + dt / 10 * np.array(step(y))))
        out.append(y)
    return np.array(out)


SYSTEMS = {
    "predation": (lambda v: (1.1 * v[0] - 0.4 * v[0] * v[1], 0.1 * v[0] * v[1] - 0.4 * v[1]), (10.0, 5.0)),
    "competition": (lambda v: (v[0] * (1 - v[0] - 0.5 * v[1]), v[1] * (0.8 - 0.3 * v[0] - v[1])), (0.1, 0.2)),
    "linear": (lambda v: (-0.5 * v[0] + v[1] + 0.2, -v[0] - 0.3 * v[1]), (2.0, 1.0)),
    "epidemic": (lambda v: (-0.9 * v[0] * v[1], 0.9 * v[0] * v[1] - 0.3 * v[1], 0.3 * v[1]), (0.99, 0.01, 0.0)),
}


@pytest.mark.parametrize("name", sorted(SYSTEMS))
def test_planted_systems_are_ranked_first(spark, name):
    step, start = SYSTEMS[name]
    x = simulated(step, start, 1500)
    x += np.random.default_rng(4).normal(size=x.shape) * (1e-4 if name == "predation" else 1e-5) * np.abs(x).max()
    states = ["s", "i", "r"][: len(start)]
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "t": np.arange(1500), **{c: x[:, n] for n, c in enumerate(states)}})).repartition(4)
    got = laws.coupled_systems(df, ["k"], ["t"], states, 0.01, width=400).orderBy("rank").collect()
    assert got[0].system == name and got[0].n == 1498 and got[0].r2 > 0.998
    if name == "predation":
        c = got[0].coefficients
        assert [round(c[k], 2) for k in ("ds:s", "ds:s*i", "di:s*i", "di:i")] == [1.1, -0.4, 0.1, -0.4]
    if name == "epidemic":
        assert sorted(round(v, 2) for v in got[0].coefficients.values()) == [0.3, 0.9]


@pytest.mark.parametrize(("name", "law"), [("power", lambda x: 3 * x**1.7), ("exponential", lambda x: 2 * np.exp(0.4 * x)), ("logarithmic", lambda x: 5 + 2 * np.log(x)), ("reciprocal", lambda x: 1 + 4 / x), ("root", lambda x: 1 + 4 * np.sqrt(x)), ("linear", lambda x: 7 + 2 * x), ("quadratic", lambda x: 7 + 2 * x + x**2)])
def test_planted_forms_are_ranked_first(spark, name, law):
    rng = np.random.default_rng(5)
    x = rng.random(900) * 9 + 1
    y = law(x) * np.exp(rng.normal(size=900) * 0.001)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    best = laws.closed_forms(df, "y", ["x"]).orderBy("rank").first()
    assert best.form == name and best.r2 > 0.999
    if name == "power":
        assert best.coefficients[1] == pytest.approx(1.7, abs=0.01)


def test_forms_of_two_features_and_of_signs(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 500))
    for name, y in (("product", 2 + 3 * a * b), ("plane", 1 + a - 2 * b), ("ratio", 1 + a / (b + 10))):
        df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b + 10 * (name == "ratio"), "y": y + rng.normal(size=500) * 1e-3}))
        got = laws.closed_forms(df, "y", ["a", "b"]).orderBy("rank").collect()
        assert (got[0].feature, got[0].form) == ("a,b", name)
        assert name == "ratio" or not {"power", "exponential"} & {r.form for r in got}
        assert "root" not in {r.form for r in got if r.feature == "a"}
    assert laws.closed_forms(df.limit(0), "y", ["a", "b"]).count() == 0


def test_form_equals_a_regression(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame(pd.DataFrame({"x": rng.random(200) * 5, "y": rng.normal(size=200)}))
    got = laws.closed_forms(df, "y", ["x"], ("linear",)).first()
    line = stats.linear_regression(df, "y", ["x"])
    assert got.coefficients == pytest.approx([line["intercept"], line["x"]]) and got.r2 == pytest.approx(line["r2"])
    assert df.agg(F.count("*")).first()[0] == got.n
