"""Queries on change points, regimes, motifs and other kernels over daily series; each is tested on planted truths."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import patterns
from sparkloom.plans.series import _days

DAY = ["day"]


def _run(kernel, values: list[str], schema: str, rounded: dict[str, int]):
    def query(spark: SparkSession, d: str) -> DataFrame:
        found = patterns.each_series(_days(spark, d), ["event_type"], DAY, values, kernel, schema)
        return found.withColumns({c: F.round(c, k) for c, k in rounded.items()})

    return query


def change_summary(spark: SparkSession, d: str) -> DataFrame:
    """Change points that two of three ways agree on, within three days: CUSUM, pruned search, Bayesian runs."""
    days = _days(spark, d)
    a = patterns.each_series(days, ["event_type"], DAY, ["v"], lambda x: patterns.cusum_points(x, limit=3.0, apart=3), "at long, side long").select("event_type", "at", F.lit("cusum").alias("way"))
    b = patterns.each_series(days, ["event_type"], DAY, ["v"], lambda x: patterns.pelt_points(x, penalty=3.0), "start long, length long, mean double, sd double").where("start > 0").select("event_type", F.col("start").alias("at"), F.lit("pruned").alias("way"))
    c = patterns.each_series(days, ["event_type"], DAY, ["v"], patterns.bayes_points, "at long, probability double").where("probability > 0.5").select("event_type", "at", F.lit("bayes").alias("way"))
    every = a.unionByName(b).unionByName(c)
    near = every.select("event_type", F.explode(F.array(*[F.col("at") + k for k in range(-3, 4)])).alias("at"), "way").distinct()
    return near.groupBy("event_type", "at").agg(F.count_distinct("way").alias("votes")).where("votes >= 2")


def warped_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = patterns.pairs_of_series(_days(spark, d), "event_type", "day", "v")
    found = patterns.each_series(pairs, ["a", "b"], DAY, ["x", "y"], patterns.warped, "distance double, bound double")
    return found.select("a", "b", F.round("distance", 5).alias("distance"), F.round("bound", 5).alias("bound"))


def information_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = patterns.pairs_of_series(_days(spark, d), "event_type", "day", "v")
    return patterns.each_series(pairs, ["a", "b"], DAY, ["x", "y"], patterns.nearest_information, "mi double").withColumn("mi", F.round("mi", 6))


def sparse_events(spark: SparkSession, d: str) -> DataFrame:
    """Days by kinds split into a matrix of low rank and one of few large entries: the entries that stand out (a matrix of days times kinds fits the driver)."""
    rows = _days(spark, d).orderBy("event_type", "day").collect()
    kinds, days = sorted({r["event_type"] for r in rows}), sorted({r["day"] for r in rows})
    m = np.zeros((len(days), len(kinds)))
    for r in rows:
        m[days.index(r["day"]), kinds.index(r["event_type"])] = r["v"]
    _, s = patterns.low_rank_and_sparse(m)
    at = np.argwhere(np.abs(s) > 0.25 * np.abs(m).mean())
    return spark.createDataFrame([(kinds[j], str(days[i]), round(float(s[i, j]), 3)) for i, j in at], "event_type string, day string, size double")


QUERIES = {
    "change_cusum": (_run(lambda x: patterns.cusum_points(x, limit=3.0, apart=3), ["v"], "at long, side long", {}), None),
    "change_segments": (_run(lambda x: patterns.pelt_points(x, penalty=3.0), ["v"], "start long, length long, mean double, sd double", {"mean": 4, "sd": 4}), None),
    "change_bayes": (_run(patterns.bayes_points, ["v"], "at long, probability double", {"probability": 6}), None),
    "change_summary": (change_summary, None),
    "series_smoothed": (_run(patterns.smoothed, ["v"], "at long, level double, low double, high double", {"level": 4, "low": 4, "high": 4}), None),
    "series_motifs": (_run(lambda x: patterns.motifs(x, 5), ["v"], "kind string, at long, other long, distance double", {"distance": 6}), None),
    "series_hop_entropy": (_run(lambda x: patterns.hop_entropy(x, 16), ["v"], "at long, entropy double, jump double", {"entropy": 6, "jump": 6}), None),
    "series_seasonal_parts": (_run(patterns.seasonal_parts, ["v"], "at long, trend double, season double, rest double", {"trend": 4, "season": 4, "rest": 4}), None),
    "series_modes": (_run(patterns.intrinsic_modes, ["v"], "mode long, at long, value double", {"value": 4}), None),
    "series_regimes": (_run(patterns.hidden_regimes, ["v"], "at long, regime long, states long", {}), None),
    "series_waves": (_run(patterns.ridge_of_waves, ["v"], "at long, period double, power double", {"period": 4, "power": 3}), None),
    "forecast_analog": (_run(lambda x: patterns.analog_forecast(x, 5, 3, 3), ["v"], "h long, value double, low double, high double", {"value": 3, "low": 3, "high": 3}), None),
    "forecast_simulated": (_run(patterns.simulated_bands, ["v"], "h long, p05 double, p50 double, p95 double", {"p05": 2, "p50": 2, "p95": 2}), None),
    "series_ar3": (_run(lambda x: patterns.ar3_residuals(x, 1.5), ["v"], "at long, z double", {"z": 5}), None),
    "physics_forms": (_run(lambda n, v: patterns.physics_forms(np.arange(len(v), dtype=float), v), ["n", "v"], "form string, rmse double, aic double", {"rmse": 4, "aic": 4}), None),
    "warped_pairs": (warped_pairs, None),
    "information_pairs": (information_pairs, None),
    "sparse_events": (sparse_events, None),
}
