"""Samples in tiers: nested, of even cells, the same for any order of the rows."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import tiers


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def series(spark, n=6000, hot=0.0):
    rng = np.random.default_rng(1)
    at = np.datetime64("2024-01-01") + (np.where(rng.random(n) < hot, 0, rng.integers(0, 40_000_000, n))).astype("timedelta64[s]")
    return spark.createDataFrame(pd.DataFrame({"at": at, "a": rng.normal(size=n), "b": rng.normal(size=n) * 10, "c": rng.normal(size=n) * 0.1}))


def test_seed_depends_on_rows_alone(spark):
    df = series(spark, 500)
    seed = tiers.content_seed(df)
    assert seed == tiers.content_seed(df.repartition(7, "a").orderBy("b")) and len(seed) == 8
    assert seed != tiers.content_seed(df.limit(499)) and seed != tiers.content_seed(df.withColumn("a", F.col("a") + 1))


@pytest.mark.parametrize(("method", "hot"), [("stratified_temporal", 0.0), ("stratified_temporal", 0.4), ("random", 0.0), ("completeness_biased", 0.0)])
def test_larger_samples_contain_smaller_ones(spark, method, hot):
    df = series(spark, hot=hot).withColumn("a", F.expr("IF(abs(a) > 1, NULL, a)"))
    one, two = (rows_of(tiers.sample(df, method, n, "at", None, "s", 500)) for n in (500, 2000))
    assert one <= two <= rows_of(df)
    again = rows_of(tiers.sample(df.repartition(5), method, 500, "at", None, "s", 500))
    assert again == one
    if not hot:
        assert abs(sum(one.values()) - 500) <= 50 and abs(sum(two.values()) - 2000) <= 200
    if method == "completeness_biased":
        assert all(r[1] is not None for r in one)


def test_strata_are_even(spark):
    df = series(spark)
    got = tiers.sample(df, "stratified_temporal", 500, "at", None, "s").toPandas()
    days = df.toPandas()["at"].sort_values().reset_index(drop=True)
    cuts = days[[round(len(days) * i / 5) for i in range(1, 5)]]
    parts = Counter(np.searchsorted(cuts, got["at"]))
    assert all(90 <= n <= 110 for n in parts.values()) and len(parts) == 5


def test_panel_cells(spark):
    rows = [(e, f"2024-01-{d:02d} 00:00:00", float(i), i) for e in range(5) for d in range(1, 29) for i in range(20 if e else 400)]
    df = spark.createDataFrame(rows, "station_id int, at string, v double, n int")
    got = tiers.sample(df, "stratified_panel", 1000, "at", "station_id", "s").collect()
    cells = Counter((r.station_id, r.at) for r in got)
    assert len({k for k, _ in cells}) == 5 and len(got) == 1000
    assert set(Counter(r.station_id for r in got).values()) == {200}


def test_tiers_by_shape(spark):
    df = series(spark)
    parts, told = tiers.tiers(df, {1: (400, 3), 2: (1500, 4), 3: (None, None)}, small=1000)
    report = {r.tier: r for r in told.collect()}
    assert {r.method for t, r in report.items() if t < 3} == {"stratified_temporal"} and report[3].method == "all" and report[1].shape == "time_series"
    assert parts[1].columns == ["at", "a", "b"] and len(parts[2].columns) == 4
    assert rows_of(parts[1]) <= rows_of(parts[2].select("at", "a", "b")) <= rows_of(df.select("at", "a", "b"))
    assert parts[3].count() == 6000
    few, said = tiers.tiers(df.limit(100))
    assert list(few) == [3] and said.first().method == "all"
    empty, _ = tiers.tiers(df.limit(0))
    assert empty[3].count() == 0
    wide = df.selectExpr("a", "b")
    assert tiers.tiers(wide, {1: (320, None), 2: (None, None)}, small=10)[1].first().method == "random"
    assert tiers.tiers(wide, {1: (320, None), 2: (None, None)}, small=10)[0][1].count() == 320
