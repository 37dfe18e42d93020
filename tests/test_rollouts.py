"""Rollouts, stepped laws and shared periods on planted truths."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import forecasting, rollouts


def series(spark, **named):
    rows = [(name, i, None if v is None else float(v)) for name, values in named.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "name string, i int, x double")


def planted(n=400):
    rng = np.random.default_rng(3)
    walk = 50 + np.cumsum(rng.normal(0, 1, n))
    back = [0.0]
    for e in rng.normal(0, 1, n - 1):
        # far out where the holdout of 50 begins: an AR(1) comes back from there, a walk stays
        back.append(6.0 if len(back) == n - 51 else 0.5 * back[-1] + e)
    return walk, back


def test_models_are_told_apart_and_bands_have_their_width(spark):
    walk, back = planted()
    df = series(spark, walk=walk, back=back, short=[5.0], gaps=[1.0, None, 2.0])
    got = {(r["name"], r["h"]): r for r in rollouts.rollout(df, ["name"], ["i"], "x", horizon=16, paths=2000, holdout=50).collect()}
    assert len(got) == 4 * 16
    assert got["walk", 1]["model"] == "random_walk" and got["back", 1]["model"] == "ar1"
    step = np.std(np.diff(walk), ddof=1)
    for h in (1, 4, 16):
        assert got["walk", h]["sd"] == pytest.approx(step * math.sqrt(h), rel=0.08)
        assert got["walk", h]["mean"] == pytest.approx(walk[-1], abs=0.12 * step * math.sqrt(h))
    # an AR(1) settles: about 1.15 for phi 0.5 and unit steps
    assert got["back", 16]["sd"] == pytest.approx(1 / math.sqrt(1 - 0.25), rel=0.12)
    assert got["back", 16]["p95"] - got["back", 16]["p05"] == pytest.approx(2 * 1.645 * got["back", 16]["sd"], rel=0.1)
    # one row: the steps have deviation 1
    assert got["short", 1]["sd"] == pytest.approx(1.0, rel=0.08)


def test_scores_equal_a_plain_version(spark):
    walk, back = planted(120)
    rows = forecasting.placed(series(spark, walk=walk, back=back, few=list(range(12))), ["name"], ["i"], "x")
    got = {(r["name"], r["model"]): r["rmse"] for r in rollouts.model_scores(rows, ["name"], 20).collect()}
    for name, values in (("walk", np.array(walk)), ("back", np.array(back)), ("few", np.arange(12.0))):
        train, test = (values[:-20], values[-20:]) if len(values) > 30 else (values, values)
        phi = float(np.clip(train[:-1] @ train[1:] / (train[:-1] @ train[:-1]), -0.99, 0.99)) if len(train) >= 20 else 0.9
        h = np.arange(1, len(test) + 1)
        assert got[name, "random_walk"] == pytest.approx(math.sqrt(np.mean((test - train[-1]) ** 2)))
        assert got[name, "ar1"] == pytest.approx(math.sqrt(np.mean((test - train[-1] * phi**h) ** 2)))


def plain_steps(law, y, s, dt, p, n, limit=5.0):
    out, v, s = [], 0.0, max(s, 0.01 * abs(y))
    for i in range(n):
        if law == "linear_ode":
            g, y = abs(1 + p["a"] * dt), y + dt * (p["a"] * y + p["b"])
        elif law == "logistic":
            g, y = abs(1 + dt * p["r"] * (1 - 2 * y / p["k"])), y + dt * p["r"] * y * (1 - y / p["k"])
        else:
            v += dt * (-p["c"] * v - p["k"] * y)
            g, y = 1.05, y + dt * v
        s = g * s + 0.01 * abs(y)
        wide = rollouts.Z * s
        out.append((i + 1, y, wide))
        if abs(y) > 1e-9 and wide / abs(y) > limit:
            break
    return out


LAWS = [
    ("decay", "linear_ode", 8.0, 0.1, 0.5, {"a": -0.4, "b": 1.0}),
    ("burst", "linear_ode", -1.0, 0.3, 1.0, {"a": 0.9, "b": 1.2}),
    ("room", "logistic", 1.0, 0.0, 1.0, {"r": 0.5, "k": 20.0}),
    ("swing", "damped_oscillator", 2.0, 0.0, 0.2, {"c": 0.3, "k": 1.0}),
]


def test_steps_equal_a_plain_version(spark):
    names = "abrck"
    rows = [(key, law, y, s, dt, *[p.get(n) for n in names]) for key, law, y, s, dt, p in LAWS]
    rows += [("none", "heat", 1.0, 0.0, 1.0, *[None] * 5), ("void", "logistic", None, 0.0, 1.0, *[None] * 5)]
    df = spark.createDataFrame(rows, "key string, law string, y double, s double, dt double, " + ", ".join(f"{n} double" for n in names))
    got = {}
    for r in rollouts.stepped(df, ["key"], 30).orderBy("key", "step").collect():
        got.setdefault(r["key"], []).append(r)
    assert set(got) == {key for key, *_ in LAWS}
    for key, law, y, s, dt, p in LAWS:
        want = plain_steps(law, y, s, dt, p, 30)
        assert [r["step"] for r in got[key]] == [i for i, _, _ in want]
        for r, (i, value, wide) in zip(got[key], want, strict=True):
            assert (r["value"], r["high"] - r["value"], r["t"]) == pytest.approx((value, wide, i * dt), rel=1e-9, abs=1e-12)
    assert got["room"][-1]["value"] == pytest.approx(20.0, abs=0.1) and len(got["room"]) == 30
    assert any(len(some) < 30 and some[-1]["paused"] for some in got.values())
    assert not any(r["paused"] for some in got.values() for r in some[:-1])


def test_a_shared_period_is_found_and_noise_shares_none(spark):
    rng = np.random.default_rng(5)
    t = np.arange(1024)
    wave = lambda shift: np.sin(2 * np.pi * t / 8 + shift) + rng.normal(0, 0.7, len(t))
    df = series(spark, a=wave(0.0), b=wave(1.1), noise=rng.normal(0, 1, len(t)), short=list(range(40)))
    got = {(r["a"], r["b"]): r for r in rollouts.shared_periods(df, [], "name", "i", "x").collect()}
    assert set(got) == {("a", "b"), ("a", "noise"), ("b", "noise")}
    assert got["a", "b"]["period"] == 8.0 and got["a", "b"]["coherence"] > 0.9
    assert got["a", "noise"]["coherence"] < 0.5
    strong = rollouts.shared_periods(df, [], "name", "i", "x", least=0.6).collect()
    assert [(r["a"], r["b"]) for r in strong] == [("a", "b")]


def test_coherence_equals_a_plain_version(spark):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(2, 200))
    df = series(spark, x=x, y=y).withColumn("g", F.lit(1))
    r = rollouts.shared_periods(df, ["g"], "name", "i", "x").first()
    cuts = [slice(s, s + 64) for s in range(0, 200 - 63, 32)]
    fx, fy = (np.array([np.fft.rfft((v[c] - v[c].mean()) * np.hanning(64)) for c in cuts])[:, 1:] for v in (x, y))
    coherence = abs((fx * fy.conj()).sum(axis=0)) ** 2 / ((abs(fx) ** 2).sum(axis=0) * (abs(fy) ** 2).sum(axis=0))
    assert (r["period"], r["coherence"]) == pytest.approx((64 / (coherence.argmax() + 1), coherence.max()))
