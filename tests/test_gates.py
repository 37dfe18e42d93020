"""Gates of the advanced steps, and the one-call analysis."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sparkloom import api
from sparkloom.operators import gates


def test_gates_follow_the_table(spark):
    df = spark.range(60).select((F.col("id") % 3).cast("string").alias("site"), F.timestamp_seconds(F.col("id") * F.col("id") * 60).alias("ts"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("treated"), (F.col("id") % 20 + 1).cast("double").alias("duration"), (F.col("id") % 2).alias("event"))
    got = {r.step: (r.applied, r.reason) for r in gates.gated(df).collect()}
    assert len(got) == 17 and got["panel"][0] and got["treatment"][0] and got["survival"][0] and got["uneven_periods"][0]
    assert got["spatial"] == (False, "no latitude and longitude") and got["composition"][0] is False
    assert gates.run(df)["survival"].count() > 0
    few = {r.step: r.applied for r in gates.gated(df.limit(3)).collect()}
    assert not few["clusters"] and not few["hidden_regimes"]
    assert not any(r.applied for r in gates.gated(df.limit(0)).collect())


def test_one_call(spark, tmp_path):
    lines = ["day,units sold,store"] + [f"2024-01-{1 + i % 28:02d},{'' if i < 40 else i % 9},{'ab'[i % 2]}" for i in range(140)]
    (tmp_path / "s.csv").write_text("\n".join(lines))
    got = api.run(spark, str(tmp_path / "s.csv"))
    assert got.contract.first().n_columns == 3 and {r.column: r.role for r in got.roles.collect()}["day"] == "datetime"
    assert got.findings.where(check="missingness", subject="units_sold").df.count() == 1
    assert got.forecast.count() == 7 and got.findings.count_by_severity()


def full_table(spark, n=640):
    rng = np.random.default_rng(1)
    i = np.arange(n)
    site, t = i % 8, i // 8
    treated = ((site % 2 == 1) & (t >= n // 16)).astype(int)
    x = rng.normal(size=n).cumsum() * 0.1 + 5 * (i > n // 2)
    y = np.concatenate(([0.0], x[:-1])) + 3.0 * treated + rng.normal(size=n) * 0.1
    group = (rng.random(n) < 0.5).astype(int)
    return spark.createDataFrame(pd.DataFrame({
        "site": [f"s{k}" for k in site], "ts": np.datetime64("2024-01-01") + (i * 3600 + rng.integers(0, 1800, n)).astype("timedelta64[s]"), "x": x, "y": y, "treated": treated,
        "duration": np.ceil(rng.exponential(10, n) * (1 + group)), "event": (rng.random(n) < 0.8).astype(int), "lat": rng.random(n) * 10, "lon": group * 100 + rng.random(n) * 10,
        "origin": [f"p{k % 4}" for k in i], "destination": [f"p{4 * (k % 2) + (k // 3) % 4}" for k in i]}))


APART = {"components", "clusters", "survival", "spatial", "network"}


def test_every_step_applies_to_a_full_table(spark):
    df = full_table(spark)
    applied = {r.step for r in gates.gated(df).collect() if r.applied}
    assert applied == {s.name for s in gates.STEPS} - {"composition"} and all(s.run for s in gates.STEPS)
    assert set(gates.facts(df).numbers) == {"x", "y", "treated", "duration", "event", "lat", "lon"}


def test_steps_of_time_and_panels(spark):
    df = full_table(spark).select("site", "ts", "x", "y", "treated")
    got = {k: v.collect() for k, v in gates.run(df, tuple(s for s in gates.STEPS if s.name not in APART)).items()}
    assert set(got) == {"mutual_information", "granger", "hidden_regimes", "wavelets", "uneven_periods", "interpolation", "sparse_dynamics", "power", "posteriors", "panel", "treatment"}
    assert all(got[k] for k in set(got) - {"uneven_periods"})
    causes = {(r.cause, r.effect, r.lag): r.p for r in got["granger"]}
    assert causes["x", "y", 1] < 1e-6 and len(causes) == 3 * 3 * 2
    assert {r.column for r in got["hidden_regimes"]} == {"x", "y", "treated"}
    effect = next(r for r in got["treatment"] if r.column == "y")
    assert effect.entities == 8 and abs(effect.effect - 3) < 1.5
    assert next(r for r in got["power"] if r.column == "y").rows_needed < 60
    assert {(r.column, r.part): r.share for r in got["panel"]}["x", "time"] > 0.5
    assert all(r.low <= r.high for r in got["panel"] + got["posteriors"])


def test_steps_of_places_lives_and_links(spark):
    df = full_table(spark, 240).select("lat", "lon", "duration", "event", "origin", "destination")
    got = gates.run(df, tuple(s for s in gates.STEPS if s.name in APART - {"components"}))
    assert {k: v.count() for k, v in got.items() if k != "survival"} == {"clusters": got["clusters"].count(), "cluster_stability": 1, "hazards": 2, "spatial": 2, "network": 1, "network_nodes": 8}


def test_compositions_and_bare_tables(spark):
    parts = spark.range(60).selectExpr("0.2 + (id % 5) / 100 AS a", "0.3 + (id % 3) / 100 AS b", "0.5 - (id % 5) / 100 - (id % 3) / 100 AS c")
    got = gates.run(parts, tuple(s for s in gates.STEPS if s.name in ("composition", "posteriors", "granger")))
    assert set(got) == {"composition", "posteriors"} and got["composition"].first().is_compositional
