"""Operators on small tables with known results, empty tables and nulls among them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import joining, profile, series, stats


def test_profile_counts_nulls_and_nans(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, float("nan"), None)], "i int, x double, s string")
    got = {r["column"]: r for r in profile.profile(df).collect()}
    assert (got["x"]["n_missing"], got["x"]["mean"], got["s"]["n_missing"], got["s"]["mean"]) == (2, 1.0, 1, None)


def test_profile_of_an_empty_table(spark):
    got = profile.profile(spark.createDataFrame([], "i int, s string")).collect()
    assert [(r["column"], r["n_total"]) for r in got] == [("i", 0), ("s", 0)]


def test_value_types(spark):
    df = spark.createDataFrame([("1,234", "x"), ("2", "1"), ("ERR", "2024-01-01"), ("4", None)], "a string, b string")
    got = {r["column"]: (r["type"], r["n_other"]) for r in profile.value_types(df, ["a", "b"]).collect()}
    assert got == {"a": ("integer", 1), "b": ("mixed", 2)}


def test_as_of_takes_the_latest_at_or_before(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 9, 90)], "k string, t int, v int")
    assert {(r.k, r.t, r.v) for r in joining.as_of(left, right, ["k"], "t", ["v"]).collect()} == {("a", 5, 50), ("a", 1, None), ("b", 5, None)}


def test_ranks_share_ties(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([3.0, 1.0, 3.0, None, 2.0])], "i int, x double")
    assert {r.i: r["rank"] for r in stats.ranks(df, "x", "i").collect()} == {1: 1.0, 4: 2.0, 0: 3.5, 2: 3.5}


def test_regression_finds_a_plane(spark):
    df = spark.range(50).select((F.col("id") % 7).alias("a"), (F.col("id") % 5).alias("b")).withColumn("y", 2 + 3 * F.col("a") - F.col("b"))
    got = stats.linear_regression(df, "y", ["a", "b"])
    assert got == pytest.approx({"intercept": 2.0, "a": 3.0, "b": -1.0, "r2": 1.0})


def test_matrix_profile_finds_a_repeat(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    x[150:170] = x[20:40]
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "k string, i int, x double")
    best = series.matrix_profile(df, ["k"], "k string", ["i"], "x", 20).orderBy("distance", "at").first()
    assert (best["at"], best["nearest"]) == (20, 150)


def test_cusum_finds_a_shift(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=100), rng.normal(5, 1, 100)])
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "k string, i int, x double")
    found = series.cusum(df, ["k"], "k string", ["i"], "x", limit=4.0).orderBy("at").first()
    assert 100 <= found["at"] <= 110 and found["side"] == 1


def test_cusum_streams_a_long_series(spark):
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=12_000), None: rng.normal(3, 2, 500), "c": np.ones(20)}
    data["a"][7000:] += 4
    data[None][100:] -= 9
    want = set()
    for k, x in data.items():
        sd, mean, up, down = x.std() or 1.0, x[: max(1, len(x) // 10)].mean(), 0.0, 0.0
        for i, v in enumerate(x):
            z = (v - mean) / sd
            up, down = max(0.0, up + z - 0.5), max(0.0, down - z - 0.5)
            if max(up, down) > 8:
                want.add((k, i, 1 if up > down else -1))
                mean, up, down = x[max(0, i - 80) : i + 1].mean(), 0.0, 0.0
    rows = [(k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)]
    got = series.cusum(spark.createDataFrame(rows, "k string, i int, x double").repartition(7), ["k"], "k string", ["i"], "x")
    assert want and {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
