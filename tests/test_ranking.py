"""Ranking of findings, levels of non-dominated rows and nearest rows, against plain versions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import joining, ranking
from sparkloom.operators.nearest import nearest


def plain_levels(points, most):
    left, out = dict(points), {}
    for level in range(1, most + 1):
        front = [k for k, p in left.items() if not any(all(b >= a for a, b in zip(p, q, strict=True)) and q != p for q in left.values())]
        out |= {k: level for k in front}
        for k in front:
            del left[k]
    return out


@pytest.mark.parametrize("block", [5, 20_000])
@pytest.mark.parametrize("figures", [1, 2, 4])
def test_levels_equal_a_plain_version(spark, figures, block):
    rng = np.random.default_rng(figures)
    points = {i: tuple(map(float, rng.integers(0, 9, figures))) for i in range(150)}
    names = [f"f{j}" for j in range(figures)]
    df = spark.createDataFrame([(k, *p) for k, p in points.items()], ["key", *names]).repartition(5)
    got = {r["key"]: r["level"] for r in ranking.levels(df, "key", names, 3, block=block).collect()}
    assert got == plain_levels(points, 3)


def test_front_of_any_size_and_rows_without_figures(spark):
    # every row is on the front, and blocks hold seven each
    df = spark.range(100).select(F.col("id"), F.col("id").alias("a"), (100 - F.col("id")).alias("b"))
    holes = spark.createDataFrame([(200, None, 5.0), (201, float("nan"), 500.0)], "id long, a double, b double")
    got = ranking.levels(df.unionByName(holes), "id", ["a", "b"], 2, block=7).collect()
    assert sorted(r["key"] for r in got) == list(range(100)) and {r["level"] for r in got} == {1}
    low = ranking.levels(df, "id", ["a"], 1, minimise=True).collect()
    assert [(r["key"], r["level"]) for r in low] == [(0, 1)]
    assert ranking.levels(df.limit(0), "id", ["a", "b"], 2).count() == 0


FINDINGS = "title string, description string, method string, confidence double, severity string, label string, z double, score double, status string"


def test_scores_of_findings(spark):
    rows = [
        ("Anomaly in pressure", "spike at noon", "iso-forest", 0.9, "crit", "pressure", 6.0, None, "novel"),
        ("Steady flow", None, None, None, None, None, None, 2.5, None),
        ("Flowmeters drift", None, "ols", 0.2, "ok", "flow meter", None, None, "pending"),
    ]
    told = ranking.scored(spark.createDataFrame(rows, FINDINGS), "Any spike in pressure or flow?").collect()
    # the question widened by the words of an anomaly has nine words, the finding six, three of them shared
    assert told[0]["relevance"] == pytest.approx(0.4 * 3 / 12 + 0.25 + 0.15 * 0.9 + 0.1 + 0.1)
    assert told[0]["surprise"] == pytest.approx(0.4 + 0.25 * (1 - told[0]["relevance"]) + 0.2 * 0.3 + 0.1 + 0.05 * 0.9)
    # a steady finding where the question speaks of a spike: contradiction 1, no severity: info
    assert told[1]["surprise"] == pytest.approx(0.4 * 0.5 + 0.25 * (1 - told[1]["relevance"]) + 0.2 + 0.1 * 0.3)
    # no word in common, but "flow" is part of "flowmeters"; a word of the label is in the question
    assert told[2]["relevance"] == pytest.approx(0.4 * 0.15 + 0.15 * 0.2 + 0.1 * 0.7 + 0.1 * 0.2)
    assert told[2]["surprise"] == pytest.approx(0.4 * 0.2 + 0.25 * (1 - told[2]["relevance"]) + 0.2 * 0.3 + 0.1 * 0.4 + 0.05 * 0.2)


def test_lists_don_t_share_findings(spark):
    rows = [(i, "Anomaly in pressure", 1.0, "crit", 9.0, "novel") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, title string, confidence double, severity string, z double, status string")
    got = ranking.two_lists(df, "pressure anomaly", "id").collect()
    assert [(r["list"], r["rank"], r["key"]) for r in got if r["list"] == "relevant"] == [("relevant", i + 1, i) for i in range(8)]
    assert [r["key"] for r in got if r["list"] == "surprise"] == list(range(8, 13))
    assert ranking.two_lists(df, "  ", "id").count() == 0


def plain_nearest(asked, rows, k, metric):
    def score(a, b):
        dots = sum(x * y for x, y in zip(a, b, strict=True))
        if metric == "inner":
            return dots
        if metric == "euclidean":
            return -math.dist(a, b)
        size = math.hypot(*a) * math.hypot(*b)
        return dots / size if size else 0.0

    sound = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in asked:
        if a is None or any(x is None or not math.isfinite(x) for x in a):
            continue
        met = sorted((-round(score(a, v), 9), i) for i, v in sound if i != q and len(v) == len(a))
        out |= {(q, i, round(-s, 6) + 0.0) for s, i in met[:k]}
    return out


@pytest.mark.parametrize("metric", ["cosine", "inner", "euclidean"])
@pytest.mark.parametrize("block", [200, 32 << 20])
def test_nearest_equals_brute_force(spark, metric, block):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(300)]
    # a third are copies; some have no vector, holes, no length or another length
    rows += [(300 + i, rows[5][1]) for i in range(150)] + [(500, None), (501, [1.0, None, 2.0, 3.0]), (502, [1.0, float("nan"), 0.0, 0.0]), (503, [0.0] * 4), (504, [1.0, 2.0])]
    asked = [r for r in rows if r[0] % 50 in (0, 3, 5)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(6)
    got = nearest(spark.createDataFrame(asked, "id long, v array<double>"), df, "id", "v", 5, metric, block_bytes=block)
    assert {(r["query_id"], r["id"], round(r["score"], 6) + 0.0) for r in got.collect()} == plain_nearest(asked, rows, 5, metric)


def test_nearest_of_nothing(spark):
    df = spark.createDataFrame([(1, [1.0])], "id long, v array<double>")
    assert nearest(df.limit(0), df, "id", "v", 3).count() == 0
    assert nearest(df, df, "id", "v", 3).count() == 0
    assert [r["id"] for r in nearest(df, df, "id", "v", 3, itself=True).collect()] == [1]
    with pytest.raises(ValueError):
        nearest(df, df, "id", "v", 3, "other")


def test_fuzzy_dedupe_compares_whole_texts_of_any_ids(spark):
    long = "alpha beta gamma delta " * 5
    rows = [(4, "one two"), (1, long + "first end here"), (2, long + "other tail then"), (3, "ONE, two"), (9, long + "first end herd"), (7, ""), (8, ""), (5, "two one!")]
    got = joining.fuzzy_dedupe(spark.createDataFrame(rows, "id long, title string"), 0.9).collect()
    assert sorted(r["id"] for r in got) == [1, 2, 3, 7, 8]
