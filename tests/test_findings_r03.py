"""What the third round's findings asked for: each test would have failed before."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from sparkloom.plans import streams


def test_first_seen_forgets_nothing(spark, tmp_path):
    """More identities than a bounded seen-set holds, each met twice, the earlier row second."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=(1 - half) * 9000 + i), i % 6000, "view", 1.0, "") for half in (0, 1) for i in range(6000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = streams.stream_first_seen(spark, str(tmp_path)).collect()
    at = lambda t: int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    assert sorted(map(tuple, got)) == sorted((f"{i}:view", at(start + dt.timedelta(seconds=i))) for i in range(6000))


def test_halves_of_means_go_up(spark, tmp_path):
    """Two parts alike but for the order in which 0.048's and 0.0475's lines add up: both are on the front."""
    from sparkloom.plans import ranking

    # added one by one, this order gives a mean of 0.047499999999999994
    low = np.random.default_rng(1117).permutation([0.03] * 4 + [0.05] * 7 + [0.07] * 5 + [0.09] * 2 + [0.04] * 2 + [0.02, 0.0, 0.02, 0.02])
    even = [0.048] * 24
    lines = [(i, k, i, 1.0, float(x)) for k, d in ((1, low), (2, even)) for i, x in enumerate(d)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 5.0, 3), (2, 5.0, 3)], "p_partkey long, p_retailprice double, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(map(tuple, ranking.pareto_many(spark, str(tmp_path)).collect())) == [(1, 1), (2, 1)]


def brute(xy, k):
    d = np.sqrt((xy[:, None, 0] - xy[None, :, 0]) ** 2 + (xy[:, None, 1] - xy[None, :, 1]) ** 2)
    np.fill_diagonal(d, np.inf)
    return {(i, int(j), r + 1) for i in range(len(xy)) for r, j in enumerate(np.lexsort((np.arange(len(xy)), d[i]))[: min(k, len(xy) - 1)])}


@pytest.mark.parametrize("kind", ["even", "clusters", "line", "same", "few"])
def test_nearest_points_once_for_all_sizes(spark, kind):
    from sparkloom.operators import estimates, models

    rng = np.random.default_rng(4)
    xy = {"even": np.floor(rng.random((700, 2)) * 40), "clusters": np.concatenate([rng.normal(c, 0.1, (120, 2)) for c in ((0, 0), (50, 3), (400, -90))]), "line": np.column_stack([np.arange(60.0) ** 2, np.zeros(60)]), "same": np.zeros((9, 2)), "few": np.array([[0.0, 0.0], [3.0, 4.0]])}[kind]
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(xy)), "x": xy[:, 0], "y": xy[:, 1]}))
    got = estimates.ranked_neighbours(df, "k", "x", "y", 7).collect()
    assert len(got) == len({(r.key, r.r) for r in got}) and {(r.key, r.other, r.r) for r in got} == brute(xy, 7)
    if kind == "clusters":
        every = {(r.key, r.k): r.lof for r in models.local_outliers_at(df, "k", "x", "y", (3, 7)).collect()}
        for k in (3, 7):
            assert all(every[r.key, k] == pytest.approx(r.lof) for r in models.local_outliers(df, "k", "x", "y", k).collect())
        assert len(every) == 2 * len(xy)


@pytest.mark.parametrize("places", [3, 40, 400])
def test_shared_places_without_pairs(spark, monkeypatch, places):
    """Degrees and triangles of dense and sparse graphs over several blocks, against sets."""
    import itertools

    from sparkloom.operators import graphs

    monkeypatch.setattr(graphs, "MET", 40)
    monkeypatch.setattr(graphs, "ASKING", 30)
    monkeypatch.setattr(graphs, "TRIPLE", 25)
    rng = np.random.default_rng(places)
    rows = [(i, int(p)) for i in range(90) for p in rng.integers(0, places, 3)] + [(200, 9999), (None, 1), (5, None)]
    df = spark.createDataFrame(rows, "u long, p long")
    near = {u: {v for v, q in rows if q is not None and v is not None and v != u and any(r == (u, q) for r in rows)} for u in range(90)}
    assert {r.node: r.degree for r in graphs.shared_degrees(df, "u", "p").collect()} == {u: len(s) for u, s in near.items() if s}
    want = sum(b in near[a] and c in near[a] and c in near[b] for a, b, c in itertools.combinations(range(90), 3))
    assert graphs.shared_triangles(df, "u", "p") == want


def test_matches_of_distinct_features(spark):
    """Many rows alike get the smallest key of the nearest; an untreated row without the feature comes last."""
    from sparkloom.operators import estimates

    rows = [(i, 1, 10.0, 2.0 + i % 2, "g") for i in range(40)] + [(100 + i, 0, 4.0, 2.0, "g") for i in range(40)] + [(50, 0, 1.0, None, "g"), (60, 1, 3.0, 1.0, "h"), (61, 0, 1.0, None, "h")]
    df = spark.createDataFrame(rows, "k long, t int, y double, q double, w string")
    got = {r.key: (r.match, r.uplift) for r in estimates.matched_uplift(df, "k", "t", "y", ["q"], ["w"]).collect()}
    assert got == {i: (100, 6.0) for i in range(40)} | {60: (61, 2.0)}


def test_firings_by_stretches(spark):
    """One kind's events go to many tasks; outcomes are those of a plain count."""
    from pyspark.sql import functions as F

    from sparkloom.operators import contracts

    rng = np.random.default_rng(3)
    at = sorted({int(x) for x in rng.integers(0, 4000, 300)} | {0, 7, 8, 16, 32, 40})
    ok = [bool(x) for x in rng.integers(0, 2, len(at))]
    rows = [(i, "a", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), s) for i, (t, s) in enumerate(zip(at, ok))]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = contracts.fired(spark.createDataFrame(rows, "i long, k string, ts timestamp, satisfied boolean"), "ts", 8, 2, ["k"], ["i"])
        assert found.select(F.spark_partition_id()).distinct().count() > 1
        got = {r.i: r.outcome for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    near = [sum(s for u, s in zip(at, ok) if t - 8 < u <= t) for t in at]
    assert got == {i: "not_satisfied" if not s else "rate_limited" if n > 2 else "fired" for i, (s, n) in enumerate(zip(ok, near))}


def test_target_without_spread(spark):
    from sparkloom.operators import structure

    df = spark.createDataFrame([(float(i), 1.0, None) for i in range(11)], "a double, total double, b double")
    got = structure.target_choice(df).first()
    assert got["column"] == "a" and got["score"] == pytest.approx(8 / 10**0.5 + 0.5)


def test_contributors_read_their_rows_once(spark, monkeypatch):
    from sparkloom.operators import features

    read = []
    monkeypatch.setattr(features, "kept", lambda df, f=features.kept: read.append(1) or f(df))
    df = spark.createDataFrame([(i, float(i % 5), float(i * i)) for i in range(50)], "k long, a double, b double")
    assert features.contributors(df, "k", ["a", "b"], most=1, parts=1).first()["key"] == 49 and read


def test_leaves_follow_their_neighbour(spark):
    """One round does for stars, a pair and a loop; leaves of a clique go with it."""
    import itertools

    from sparkloom.operators import graphs

    edges = [(100 * s, 100 * s + i) for s in range(1, 5) for i in range(1, 9)] + [(900, 901), (950, 950)]
    edges += [p for c in (1000, 2000) for p in itertools.combinations(range(c, c + 4), 2)] + [(1000, 2000), (1001, 1100), (2001, 2100)]
    found, levels = graphs.louvain(spark.createDataFrame(edges, "a int, b int"), rounds=1)
    got = {r.node: r.community for r in found.collect()}
    assert all(got[100 * s + i] == 100 * s for s in range(1, 5) for i in range(9)) and got[901] == got[900] == 900 and got[950] == 950
    assert got[1100] == got[1001] and got[2100] == got[2001] and levels.count() >= 1


def test_betweenness_of_what_hangs_on_cycles_in_blocks(spark, monkeypatch):
    """Stars fold away without a frontier; cycles with trees on them go in several blocks, and both are Brandes'."""
    from sparkloom.operators import graphs

    from .test_graphs import brandes

    stars = [(100 * s, 100 * s + i) for s in range(1, 4) for i in range(1, 7)] + [(900, 901)]
    asked = []
    monkeypatch.setattr(graphs, "_dependencies", lambda arcs, some, *more, f=graphs._dependencies: asked.append(some.count()) or f(arcs, some, *more))
    for edges in (stars, [*stars, (1, 2), (2, 3), (3, 4), (4, 1), (1, 5), (5, 6), (5, 7), (2, 8)]):
        got = {r.node: r.betweenness for r in graphs.betweenness(spark.createDataFrame(edges, "a long, b long")).collect()}
        want = brandes(edges)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
        assert sum(asked) == (0 if edges is stars else 4)
        monkeypatch.setattr(graphs, "REACHED", 6)
    assert len(asked) > 1


def test_spanning_tree_over_tiles(spark, monkeypatch):
    """Small tiles, points of one place and a dense spot: the tree is Kruskal's edge by edge, and no pair of points of one place is made."""
    import itertools

    from sparkloom.operators import graphs

    from .test_graphs import kruskal

    monkeypatch.setattr(graphs, "ACROSS", 3)
    monkeypatch.setattr(graphs, "PAIRS", 100)
    rng = np.random.default_rng(6)
    xy = np.concatenate([np.floor(rng.random((220, 2)) * 25), rng.normal(9, 0.01, (60, 2)), np.full((70, 2), 3.0)])
    seen = []
    monkeypatch.setattr(graphs, "_joined_within", lambda state, *more, f=graphs._joined_within: seen.append(state.count()) or f(state, *more))
    got = graphs.components_born_and_dead(spark.createDataFrame(pd.DataFrame({"k": np.arange(len(xy)), "x": xy[:, 0], "y": xy[:, 1]})), "k", ["x", "y"]).collect()
    want = kruskal([(i, j, float(np.sqrt(((xy[i] - xy[j]) ** 2).sum()))) for i, j in itertools.combinations(range(len(xy)), 2)])
    assert sorted((r.a, r.b, r.death) for r in got if r.a is not None) == sorted(want) and len(got) == len(xy)
    assert seen[0] == len(np.unique(xy, axis=0))


def test_perturbed_rows_are_dealt_out(spark):
    """The rows of one input task are repeated by several."""
    from pyspark.sql import functions as F

    from sparkloom.operators import robustness

    df = spark.createDataFrame([(i, float(i)) for i in range(1, 200)], "k long, x double").coalesce(1)
    assert robustness.perturbed(df, "k", ["x"], 3).select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_short_vectors_meet_few(spark, monkeypatch, metric):
    """Copies, vectors of no length and rows alike in a coordinate: the lists are those of all pairs, and far fewer pairs are scored."""
    from sparkloom.operators import nearest as n

    monkeypatch.setattr(n, "STRETCH", 40, raising=False)
    monkeypatch.setattr(n, "HELD", 60, raising=False)
    monkeypatch.setattr(n, "_block", None)
    rng = np.random.default_rng(8)
    v = np.concatenate([np.round(rng.random((500, 3)) * [50, 80, 9], 3), np.repeat([[7.0, 5.0, 1.0]], 90, axis=0), np.zeros((3, 3)), np.column_stack([np.full(80, 3.0), rng.random((80, 2))])])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, v array<double>")
    got = {(r.query_id, r.k) for r in n.nearest(df.where("k % 20 = 0 OR k = 591"), df, "k", "v", 4, metric).collect()}
    want = set()
    for q in [*range(0, len(v), 20), 591]:
        s = np.round(n._scores(metric, v[q : q + 1], v)[0], 9)
        s[q] = -np.inf
        want |= {(q, int(j)) for j in np.lexsort((np.arange(len(v)), -s))[:4]}
    assert got == want
