"""Slices of long series against kernels that hold the whole series."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from sparkloom.operators import patterns, series, slices


def walk(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n).cumsum()
    x[n // 2 : n // 2 + 40] = x[n // 5 : n // 5 + 40] * 2 + 5
    return x


def table_of(spark, x, key="a", parts=5):
    return spark.createDataFrame(pd.DataFrame({"k": key, "t": np.arange(len(x)), "v": x})).repartition(parts)


@pytest.mark.parametrize(("n", "width"), [(2000, 300), (10_000, 4000)])
def test_profile_and_motifs_equal_the_whole_series_kernel(spark, n, width):
    x = walk(n)
    df = table_of(spark, x)
    found = slices.kept(slices.profile(df, ["k"], ["t"], "v", 40, width))
    got = found.toPandas().sort_values("at")
    want = series.matrix_profile(df, ["k"], "k string", ["t"], "v", 40).toPandas().sort_values("at")
    assert got["at"].tolist() == want["at"].tolist()
    assert np.allclose(got["distance"], want["distance"], atol=1e-6)
    assert (got["nearest"].to_numpy() == want["nearest"].to_numpy()).mean() > 0.999
    told = slices.motifs_and_discords(found, ["k"], 40).toPandas().sort_values(["kind", "rank"], ascending=[False, True])
    plain = patterns.motifs(x, 40)
    assert told["kind"].tolist() == plain["kind"].tolist()
    assert np.allclose(told["distance"], plain["distance"], atol=1e-6) and told["at"].tolist() == plain["at"].tolist()
    assert told.iloc[0][["at", "other"]].tolist() == [n // 5, n // 2]


def test_no_task_holds_a_series(spark):
    df = table_of(spark, walk(3000))
    cut = slices.slices(slices.numbered(df, ["k"], ["t"], ["v"]), ["k"], 39, 500)
    sizes = sorted(r.n for r in cut.selectExpr("size(xs) AS n").collect())
    assert sizes == [500] + [539] * 5
    with pytest.raises(ValueError, match="halo"):
        slices.slices(cut, ["k"], 9, 5)


def test_places_of_ties_nulls_and_several_series(spark):
    rows = [("a", 1, 2.0), ("a", 1, 1.0), ("a", 0, 3.0), ("b", 5, 1.0), ("b", 4, None), (None, 1, 1.0), ("a", None, 1.0)] + [("c", i, float(i)) for i in range(400)]
    got = slices.numbered(spark.createDataFrame(rows, "k string, t int, v double").repartition(6), ["k"], ["t"], ["v"]).collect()
    told = {(r.k, r.at): r.x[0] for r in got}
    assert [told["a", i] for i in range(3)] == [3.0, 1.0, 2.0] and told["b", 0] == 1.0
    assert all(told["c", i] == i for i in range(400)) and len(told) == len(got) == 404
    empty = spark.createDataFrame([], "k string, t int, v double")
    assert slices.profile(empty, ["k"], ["t"], "v", 5).count() == 0
    assert slices.profile(spark.createDataFrame(rows[:3], "k string, t int, v double"), ["k"], ["t"], "v", 5).count() == 0


def test_flat_windows_are_at_distance_of_their_norm(spark):
    x = np.concatenate([np.ones(30), np.sin(np.arange(40)), np.ones(30)])
    df = table_of(spark, x)
    got = slices.profile(df, ["k"], ["t"], "v", 6, 20).toPandas().sort_values("at")
    want = series.matrix_profile(df, ["k"], "k string", ["t"], "v", 6).toPandas().sort_values("at")
    assert np.allclose(got["distance"], want["distance"], atol=1e-6)


def test_motif_library_finds_planted_shapes(spark):
    up, down = np.arange(6.0), np.arange(6.0)[::-1]
    x = np.concatenate([s + 20 * (i % 2) for i, s in enumerate([up, down] * 25)])
    rows = slices.numbered(table_of(spark, x), ["k"], ["t"], ["v"])
    every = slices.windows(rows, ["k"], 6, 50)
    assert every.count() == len(x) - 5
    library, labelled = slices.motif_library(every.where("at % 6 = 0"), 2)
    centres = sorted(tuple(np.round(r.centroid, 6)) for r in library.collect())
    assert centres == sorted([tuple(up), tuple(down + 20)]) and {r.n for r in library.collect()} == {25}
    near = slices.similar_to_latest(labelled, library, ["k"], 1, 3).collect()
    assert len(near) == 3 and all(r.distance == 0 and r.at % 12 == 6 for r in near)


def test_windows_of_several_columns(spark):
    df = table_of(spark, np.arange(10.0)).selectExpr("k", "t", "v", "-v AS u")
    got = slices.windows(slices.numbered(df, ["k"], ["t"], ["v", "u"]), ["k"], 3, 4).collect()
    assert sorted((r.at, r.w) for r in got) == [(i, [float(s * (i + j)) for j in range(3) for s in (1, -1)]) for i in range(8)]


def test_regime_labels_and_lines(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.1, 60), rng.normal(50, 0.1, 60), rng.normal(100, 0.1, 60)])
    rows = slices.numbered(table_of(spark, x), ["k"], ["t"], ["v"])
    got = {r.at: r.regime for r in slices.regime_labels(rows, ["k"]).collect()}
    assert [got[i] for i in range(9)] == [-1] * 9
    assert {got[i] for i in range(9, 60)} == {0} and {got[i] for i in range(70, 120)} == {1} and {got[i] for i in range(130, 180)} == {2}
    df = table_of(spark, x).selectExpr("v AS x", "CASE WHEN v < 25 THEN 2 * v + 1 WHEN v < 75 THEN 5 - v ELSE 3 * v END AS y")
    lines = slices.by_regime(df, ["x"], "y").collect()
    assert sorted(np.round(r.coefficients[1], 6) for r in lines) == [-1, 2, 3] and all(r.n == 60 and r.r2 > 0.999 for r in lines)
    odd = slices.regimes_and_anomalies(df.selectExpr("x", "y", "x AS z"), ["x", "z"], k=2).orderBy("score", ascending=False).collect()
    assert len(odd) == 180 and odd[0].score > odd[-1].score


def test_hop_entropy_equals_the_kernel(spark):
    x = np.sin(np.arange(400) / 3) + np.random.default_rng(3).normal(size=400)
    got = slices.hop_entropy(slices.numbered(table_of(spark, x), ["k"], ["t"], ["v"]), ["k"], 64, 100).toPandas().sort_values("at")
    want = patterns.hop_entropy(x, 64)
    assert got["at"].tolist() == want["at"].tolist()
    assert np.allclose(got[["entropy", "jump"]], want[["entropy", "jump"]], atol=1e-9)
