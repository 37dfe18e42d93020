"""Queries on long series that are cut into overlapping slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import motifs, slices
from sparkloom.plans.series import _DAYS, _days
from sparkloom.packaging import shipped
from sparkloom.sources import table

KIND, ORDER = ["event_type"], ["ts", "event_id"]


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events of each kind as one series, whatever its length."""
    return slices.numbered(table(shipped(spark), d, "events"), KIND, ORDER, ["value"])


def sliced_profile(spark: SparkSession, d: str) -> DataFrame:
    """The matrix profile of daily values, slices of eight days."""
    found = slices.profile(_days(spark, d), KIND, ["day"], "v", 5, width=8)
    return found.select("event_type", "at", F.round("distance", 5).alias("distance"))


PROFILE_SQL = f"""
WITH {_DAYS},
r AS (
  SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS p FROM days),
w AS (
  SELECT a.event_type, a.p, b.p - a.p AS i, b.v,
    avg(b.v) OVER (PARTITION BY a.event_type, a.p) AS m,
    stddev_pop(b.v) OVER (PARTITION BY a.event_type, a.p) AS s,
    count(*) OVER (PARTITION BY a.event_type, a.p) AS n
  FROM r a JOIN r b ON a.event_type = b.event_type AND b.p BETWEEN a.p AND a.p + 4),
z AS (SELECT event_type, p, i, (v - m) / s AS z FROM w WHERE n = 5),
d AS (
  SELECT a.event_type, a.p, b.p AS other, sqrt(sum((a.z - b.z) * (a.z - b.z))) AS d
  FROM z a JOIN z b ON a.event_type = b.event_type AND a.i = b.i AND abs(a.p - b.p) >= 2
  GROUP BY a.event_type, a.p, b.p)
SELECT event_type, p AS "at", round(min(d), 5) AS distance FROM d GROUP BY event_type, p
"""


def sliced_motifs(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest pairs and the three furthest windows of 20 events, of all events of each kind."""
    events = table(shipped(spark), d, "events")
    return motifs.motifs_and_discords(events, KIND, ORDER, "value", 20).withColumn("distance", F.round("distance", 6))


def sliced_windows(spark: SparkSession, d: str) -> DataFrame:
    """Mean and largest value of every window of seven events of a kind."""
    w = F.aggregate("w", F.lit(0.0), lambda s, v: s + v)
    return slices.windows(_events(spark, d), KIND, 7, 50).select("event_type", "at", F.round(w / 7, 4).alias("mean"), F.array_max("w").alias("largest"))


WINDOWS_SQL = """
WITH r AS (
  SELECT event_type, row_number() OVER o - 1 AS p, count(*) OVER f AS n, avg(value) OVER f AS m, max(value) OVER f AS l
  FROM events
  WINDOW o AS (PARTITION BY event_type ORDER BY ts, event_id),
    f AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING))
SELECT event_type, p AS "at", round(m, 4) AS mean, l AS largest FROM r WHERE n = 7
"""


def sliced_places(spark: SparkSession, d: str) -> DataFrame:
    """Each event's place among those of its kind."""
    return _events(spark, d).select("event_type", "event_id", "at")


def motif_table(spark: SparkSession, d: str) -> DataFrame:
    """Five motifs of windows of seven events, learned from all events of all kinds."""
    library, _ = slices.motif_library(slices.windows(_events(spark, d), KIND, 7))
    return library.select("motif", "n", F.transform("centroid", lambda v: F.round(v, 3)).alias("centroid"))


def motif_search(spark: SparkSession, d: str) -> DataFrame:
    """The windows most like the last one of each kind, in the motifs nearest to it."""
    library, labelled = slices.motif_library(slices.windows(_events(spark, d), KIND, 7))
    return slices.similar_to_latest(labelled, library, KIND).withColumn("distance", F.round("distance", 5))


def event_regimes(spark: SparkSession, d: str) -> DataFrame:
    """How many events of each kind end a window of each regime."""
    return slices.regime_labels(_events(spark, d), KIND).groupBy("event_type", "regime").agg(F.count("*").alias("n"))


def order_regimes(spark: SparkSession, d: str) -> DataFrame:
    """Line items in three regimes of their principal components, with how far the furthest lies off."""
    found = slices.regimes_and_anomalies(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return found.groupBy("regime").agg(F.count("*").alias("n"), F.round(F.max("score"), 2).alias("furthest"))


def regime_lines(spark: SparkSession, d: str) -> DataFrame:
    """The price of line items by quantity and discount, a line for each regime."""
    found = slices.by_regime(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    return found.select("regime", "n", F.transform("coefficients", lambda v: F.round(v, 3)).alias("coefficients"), F.round("r2", 5).alias("r2"))


def sliced_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Spectral entropy of windows of 64 events of a kind, hopping by 32."""
    found = slices.hop_entropy(_events(spark, d), KIND, 64)
    return found.select("event_type", "at", F.round("entropy", 6).alias("entropy"), F.round("jump", 6).alias("jump"))


QUERIES = {
    "sliced_profile": (sliced_profile, PROFILE_SQL),
    "sliced_motifs": (sliced_motifs, None),
    "sliced_windows": (sliced_windows, WINDOWS_SQL),
    "sliced_places": (sliced_places, "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS \"at\" FROM events"),
    "sliced_entropy": (sliced_entropy, None),
    "motif_table": (motif_table, None),
    "motif_search": (motif_search, None),
    "event_regimes": (event_regimes, None),
    "order_regimes": (order_regimes, None),
    "regime_lines": (regime_lines, None),
}
