"""Bands, weights, rolling origins, dealt targets, regressors, pins and vector tables on planted truths."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import registry, robustness


def test_bands_have_the_width_of_the_noise(spark):
    df = spark.range(400).select(F.col("id"), F.lit(10.0).alias("x"), F.when(F.col("id") < 300, F.lit(1.0)).alias("y"))
    got = {r["figure"]: r for r in robustness.ensemble(df, "id", ["x", "y"], {"m": F.avg("x"), "n": F.count("y")}, runs=200).collect()}
    # a mean of 400 values with 2 % noise on 10
    assert got["m"]["sd"] == pytest.approx(0.2 / 20, rel=0.2) and got["m"]["mean"] == pytest.approx(10, abs=0.004)
    assert got["m"]["q05"] < got["m"]["q25"] < got["m"]["q50"] < got["m"]["q75"] < got["m"]["q95"]
    assert (got["n"]["q05"], got["n"]["q95"], got["n"]["sd"]) == (300, 300, 0)
    assert robustness.ensemble(df.limit(0), "id", ["x"], {"m": F.avg("x")}, runs=3).count() == 0


def test_one_weight_at_a_time(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 8.0)], "a double, b double")
    got = {(r["weight"], r["change"]): (r["base"], r["delta"]) for r in robustness.weight_changes(df, {"a": 2.0, "b": -1.0}, lambda w: F.sum(w["a"] * F.col("a") + w["b"] * F.col("b"))).collect()}
    assert len(got) == 8
    assert got["a", 0.1] == pytest.approx((-4.0, 0.8)) and got["b", -0.2] == pytest.approx((-4.0, 2.4))


def test_rolling_origins_choose_the_season(spark):
    rng = np.random.default_rng(4)
    week = [0, 5, 9, 2, 7, 1, 4]
    rows = [("week", i, week[i % 7] * 10.0 + float(rng.normal())) for i in range(70)] + [("short", i, 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "name string, i int, x double")
    errors = {(r["name"], r["method"]): r for r in robustness.rolling_errors(df, ["name"], ["i"], "x", 7, 4).collect()}
    assert {n for n, _ in errors} == {"week"} and all(r["origins"] == 4 for r in errors.values())
    # by hand: the value a week before, from four origins
    x = np.array([r[2] for r in rows if r[0] == "week"])
    want = np.mean([np.sqrt(np.mean((x[70 - 7 * o : 77 - 7 * o] - x[63 - 7 * o : 70 - 7 * o]) ** 2)) for o in range(1, 5)])
    assert errors["week", "seasonal"]["rmse"] == pytest.approx(want)
    got = robustness.rolling_chosen(df, ["name"], ["i"], "x", 7, 4).collect()
    assert {(r["name"], r["method"]) for r in got} == {("week", "seasonal"), ("short", "flat")}
    assert len(got) == 14 and all((r["rmse"] is None) == (r["name"] == "short") for r in got)


def test_dealt_targets_are_all_used_and_break_the_fit(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=500)
    df = spark.createDataFrame([(i, float(v), float(3 * v + rng.normal())) for i, v in enumerate(x)], "id long, x double, y double").repartition(5)
    new = robustness.dealt(df, "id", "y").collect()
    old = {r["id"]: r for r in df.collect()}
    assert sorted(r["y"] for r in new) == sorted(r["y"] for r in old.values())
    assert all(r["x"] == old[r["id"]]["x"] for r in new) and sum(r["y"] == old[r["id"]]["y"] for r in new) < 10
    told = robustness.shuffled_fit(df, "id", "y", ["x"]).first()
    assert told["n"] == 500 and told["r2"] > 0.85 and told["r2_shuffled"] < 0.02


def test_regressors_choose_by_the_rows_held_out(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(-2, 2, (600, 2))
    line = spark.createDataFrame([(i, float(a), float(b), float(2 * a - b)) for i, (a, b) in enumerate(x)], "id long, a double, b double, y double")
    got = {r["model"]: r for r in robustness.regressors(line, "id", "y", ["a", "b"], trees=5).collect()}
    assert [m for m, r in got.items() if r["best"]] == ["linear"] and got["linear"]["r2"] > 0.999
    assert got["linear"]["n_train"] + got["linear"]["n_test"] == 600 and 100 < got["linear"]["n_test"] < 200
    steps = line.withColumn("y", F.when(F.col("a") * F.col("b") > 0, 5.0).otherwise(-5.0))
    assert not {r["model"]: r for r in robustness.regressors(steps, "id", "y", ["a", "b"], trees=5).collect()}["linear"]["best"]


def test_pins_move_up_and_keep_their_notes(spark):
    log = [("w", "a", 1, "first"), ("w", "b", 2, None), ("w", "a", 5, None), ("w", "c", 3, "x"), ("w", "c", 4, "y"), ("v", "a", 1, None), ("w", None, 9, "z"), ("w", "", 9, "z")]
    got = registry.pins(spark.createDataFrame(log, "ws string, run string, at int, note string"), "ws", "run", "at", "note", 2).collect()
    assert sorted((r["ws"], r["place"], r["run"], r["at"], r["note"]) for r in got) == [("v", 1, "a", 1, None), ("w", 1, "a", 5, "first"), ("w", 2, "c", 4, "y")]


def test_vector_table_adds_removes_and_compacts(spark, tmp_path):
    store = registry.VectorTable(spark, f"file://{tmp_path}/vectors", 2)
    assert store.rows().count() == 0
    rows = lambda *r: spark.createDataFrame(list(r), "id long, v array<double>")
    assert store.add(rows((1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]))) == 1
    assert store.remove(rows((2, None), (9, None))) == 2
    assert store.add(rows((3, [0.0, 2.0]), (4, [0.0, -1.0]))) == 3
    with pytest.raises(ValueError):
        store.add(rows((5, [1.0])))
    want = {1: [0.6, 0.8], 3: [0.0, 1.0], 4: [0.0, -1.0]}
    assert {r["id"]: r["v"] for r in store.rows().collect()} == want
    small = store.compact(f"file://{tmp_path}/compact")
    assert {r["id"]: r["v"] for r in small.rows().collect()} == want
    assert [(r["id"], round(r["score"], 9)) for r in small.search(rows((3, [0.0, 5.0])), 2).orderBy(F.desc("score")).collect()] == [(3, 1.0), (1, 0.8)]
    # a removed id comes back when it is added again
    small.remove(rows((3, None)))
    small.add(rows((3, [1.0, 0.0])))
    assert {r["id"]: r["v"] for r in small.rows().collect()} == want | {3: [1.0, 0.0]}
