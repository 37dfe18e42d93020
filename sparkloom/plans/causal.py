"""Queries on adjustment by a graph, and on series that tell of each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import adjustment, autoregression
from sparkloom.packaging import shipped
from sparkloom.sources import table

#: What drives what among the columns of line items and their parts.
ARCS = [("p_retailprice", "l_quantity"), ("p_retailprice", "l_extendedprice"), ("l_quantity", "l_extendedprice"), ("l_extendedprice", "l_tax"), ("p_size", "p_retailprice")]


def _items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return items, spark.createDataFrame(ARCS, "source string, target string")


def adjusted_effects(spark: SparkSession, d: str) -> DataFrame:
    """The effect of quantity on price with what the graph says held, and of price on quantity, which can't be told."""
    items, arcs = _items(spark, d)
    out = None
    for treatment, outcome in (("l_quantity", "l_extendedprice"), ("l_extendedprice", "l_quantity"), ("p_size", "l_quantity")):
        found = adjustment.effect(items, arcs, treatment, outcome, 30.0).select(F.lit(treatment).alias("treatment"), F.lit(outcome).alias("outcome"), "status", F.array_join("adjustment", ",").alias("held"), F.round("effect", 4).alias("effect"), F.round("predicted", 2).alias("predicted"), "n")
        out = found if out is None else out.unionByName(found)
    return out


EFFECTS_SQL = """
WITH i AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (
  SELECT count(*) AS n, avg(l_quantity) AS mq, avg(l_extendedprice) AS mx, avg(p_size) AS ms,
    covar_pop(l_quantity, l_extendedprice) AS qx, covar_pop(p_retailprice, l_extendedprice) AS rx,
    covar_pop(l_quantity, p_retailprice) AS qr, var_pop(l_quantity) AS q, var_pop(p_retailprice) AS r,
    covar_pop(p_size, l_quantity) / var_pop(p_size) AS b3
  FROM i),
b AS (SELECT *, (qx * r - rx * qr) / (q * r - qr * qr) AS b1 FROM s)
SELECT 'l_quantity' AS treatment, 'l_extendedprice' AS outcome, 'IDENTIFIED' AS status, 'p_retailprice' AS held,
  round(b1, 4) AS effect, round(mx + b1 * (30 - mq), 2) AS predicted, n FROM b
UNION ALL
SELECT 'l_extendedprice', 'l_quantity', 'UNIDENTIFIABLE', NULL, NULL, NULL, NULL
UNION ALL
SELECT 'p_size', 'l_quantity', 'IDENTIFIED', '', round(b3, 4), round(mq + b3 * (30 - ms), 2), n FROM b
"""


def counterfactual_prices(spark: SparkSession, d: str) -> DataFrame:
    """By return flag, what prices would have been if each line item had been of ten pieces."""
    items, arcs = _items(spark, d)
    found = adjustment.counterfactual(items, arcs, "l_quantity", "l_extendedprice", F.lit(10.0))
    return found.groupBy("l_returnflag").agg(F.round(F.avg("cf_outcome"), 2).alias("would_be"), F.round(F.avg("delta"), 2).alias("delta"))


COUNTERFACTUAL_SQL = """
WITH i AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey),
b AS (
  SELECT (covar_pop(l_quantity, l_extendedprice) * var_pop(p_retailprice) - covar_pop(p_retailprice, l_extendedprice) * covar_pop(l_quantity, p_retailprice))
    / (var_pop(l_quantity) * var_pop(p_retailprice) - covar_pop(l_quantity, p_retailprice) * covar_pop(l_quantity, p_retailprice)) AS b
  FROM i)
SELECT l_returnflag, round(avg(l_extendedprice + b * (10 - l_quantity)), 2) AS would_be, round(avg(b * (10 - l_quantity)), 2) AS delta
FROM i, b GROUP BY 1
"""


def _hours(spark: SparkSession, d: str) -> DataFrame:
    """Events, their value and those over 100 of each hour."""
    hour = F.date_trunc("hour", "ts").alias("hour")
    return table(shipped(spark), d, "events").groupBy(hour).agg(F.count("*").cast("double").alias("n"), F.round(F.sum("value"), 4).alias("v"), F.count_if(F.col("value") > 100).cast("double").alias("large"))


def var_fit(spark: SparkSession, d: str) -> DataFrame:
    """A vector autoregression of hourly events, its order by AIC, and its strongest coupling."""
    fits, _ = autoregression.vector_autoregression(_hours(spark, d), [], ["hour"], ["n", "v", "large"])
    return fits.select("n", "order", "source", "target", F.round("coupling", 6).alias("coupling"))


def var_forecast(spark: SparkSession, d: str) -> DataFrame:
    """Its forecasts for the next twelve hours."""
    _, forecasts = autoregression.vector_autoregression(_hours(spark, d), [], ["hour"], ["n", "v", "large"])
    return forecasts.withColumn("value", F.round("value", 4))


def granger_pairs(spark: SparkSession, d: str) -> DataFrame:
    """F-tests of each hourly column on each other at lags 1 to 4."""
    found = autoregression.granger(_hours(spark, d), [], ["hour"], ["n", "v", "large"])
    return found.withColumns({"f": F.round("f", 6), "p": F.round("p", 6)})


def transfer_entropies(spark: SparkSession, d: str) -> DataFrame:
    """What each hourly column tells of each other's next value."""
    return autoregression.transfer_entropy(_hours(spark, d), [], ["hour"], ["n", "v", "large"]).withColumn("te", F.round("te", 8))


def _entropy_sql() -> str:
    columns = ("n", "v", "large")
    cell = lambda s, c: f"CASE WHEN max({s}_{c}) OVER () > min({s}_{c}) OVER () THEN least(5, floor(({s}_{c} - min({s}_{c}) OVER ()) / (max({s}_{c}) OVER () - min({s}_{c}) OVER ()) * 6)) ELSE 0 END AS {s}{c}"
    pairs = [(x, y) for x in columns for y in columns if x != y]
    return f"""
WITH h AS (
  SELECT date_trunc('hour', ts) AS hour, count(*)::DOUBLE AS n, round(sum(value), 4) AS v, count(*) FILTER (WHERE value > 100)::DOUBLE AS large
  FROM events GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY hour) AS i FROM h),
l AS (
  SELECT {", ".join(f"b.{c} AS b_{c}, a.{c} AS a_{c}" for c in columns)}
  FROM r a JOIN r b ON a.i = b.i + 1),
c AS (SELECT {", ".join(cell(s, c) for s in "ab" for c in columns)} FROM l),
p AS ({" UNION ALL ".join(f"SELECT '{x}' AS cause, '{y}' AS effect, b{x} AS x, a{y} AS y, b{y} AS z FROM c" for x, y in pairs)}),
j AS (SELECT cause, effect, x, y, z, count(*)::DOUBLE AS m FROM p GROUP BY cause, effect, x, y, z),
t AS (
  SELECT cause, effect, m, sum(m) OVER (PARTITION BY cause, effect) AS total, sum(m) OVER (PARTITION BY cause, effect, z) AS nz,
    sum(m) OVER (PARTITION BY cause, effect, x, z) AS nxz, sum(m) OVER (PARTITION BY cause, effect, y, z) AS nyz
  FROM j)
SELECT cause, effect, max(total)::BIGINT AS n, round(sum(m / total * ln(m * nz / (nxz * nyz))), 8) AS te FROM t GROUP BY cause, effect
"""


QUERIES = {
    "adjusted_effects": (adjusted_effects, EFFECTS_SQL),
    "counterfactual_prices": (counterfactual_prices, COUNTERFACTUAL_SQL),
    "var_fit": (var_fit, None),
    "var_forecast": (var_forecast, None),
    "granger_pairs": (granger_pairs, None),
    "transfer_entropies": (transfer_entropies, _entropy_sql()),
}
