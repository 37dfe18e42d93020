"""Queries on aggregates, effects, survival, dependence and regression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import erfc_sql, normal_tail
from sparkloom.operators import estimates, graphs, stats
from sparkloom.sources import table


def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(net), 2).alias("sum_net"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def correlation_pairs(spark: SparkSession, d: str) -> DataFrame:
    return stats.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).select("a", "b", F.round("r", 6).alias("r"))


_C = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CORR_SQL = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_C) for b in _C[i + 1 :])


def spearman(spark: SparkSession, d: str) -> DataFrame:
    return stats.spearman(table(spark, d, "part"), "p_size", "p_retailprice", "p_partkey").select(F.round("rho", 6).alias("rho"))


SPEARMAN_SQL = """
WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part)
SELECT round(corr(a, b), 6) AS rho FROM r
"""


def histogram(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    lo, hi = o.agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    return o.groupBy(F.least(F.lit(9), F.floor((F.col("o_totalprice") - lo) / (hi - lo) * 10)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def robust_anomalies(spark: SparkSession, d: str) -> DataFrame:
    z = stats.robust_z(table(spark, d, "events"), "value", ["event_type"])
    return z.where("abs(z) >= 2.5").select("event_id", "event_type", F.round("z", 6).alias("z"))


ROBUST_SQL = """
WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1), a AS (SELECT e.*, m FROM events e JOIN m USING (event_type)),
s AS (SELECT event_type, median(abs(value - m)) AS mad, count(*) AS n FROM a GROUP BY 1)
SELECT event_id, event_type, round(0.6745 * (value - m) / mad, 6) AS z FROM a JOIN s USING (event_type) WHERE mad > 0 AND n >= 10 AND abs(0.6745 * (value - m) / mad) >= 2.5
"""


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    m, s = e.agg(F.avg("value"), F.stddev_pop("value")).first()
    z = F.abs((F.col("value") - m) / s)
    parts = [F.struct(F.lit(t).alias("threshold"), F.count_if(z > t).alias("n"), F.round(F.count_if(z > t) / F.count("*"), 9).alias("share")) for t in (1.0, 1.5, 2.0, 2.5, 3.0)]
    return e.agg(F.array(*parts).alias("p")).select(F.inline("p"))


SWEEP_SQL = "WITH z AS (SELECT abs((value - avg(value) OVER ()) / stddev_pop(value) OVER ()) AS z FROM events) SELECT t.threshold::DOUBLE AS threshold, count(*) FILTER (WHERE z > threshold) AS n, round((count(*) FILTER (WHERE z > threshold))::DOUBLE / count(*), 9) AS share FROM z, (VALUES (1.0), (1.5), (2.0), (2.5), (3.0)) t(threshold) GROUP BY 1"


def effect_sizes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    a = stats.cohens_d(o, "o_totalprice", F.col("o_orderstatus") == "F").select(F.lit("cohens_d").alias("measure"), F.round("d", 9).alias("value"))
    b = stats.eta_squared(o, "o_totalprice", "o_orderpriority").select(F.lit("eta_squared").alias("measure"), F.round("eta_squared", 9).alias("value"))
    c = stats.odds_ratio(o, F.col("o_orderstatus") == "F", F.col("o_totalprice") > 150000).select(F.lit("odds_ratio").alias("measure"), F.round("ratio", 9).alias("value"))
    return a.unionByName(b).unionByName(c)


EFFECT_SQL = """
WITH g AS (SELECT o_orderstatus = 'F' AS t, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1), a AS (SELECT * FROM g WHERE t), b AS (SELECT * FROM g WHERE NOT t),
p AS (SELECT o_orderpriority, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1), w AS (SELECT count(*) AS n, sum(o_totalprice) AS s, sum(o_totalprice * o_totalprice) AS q FROM orders),
c AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 150000) + 0.5::DOUBLE AS a, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice <= 150000) + 0.5::DOUBLE AS b,
 count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_totalprice > 150000) + 0.5::DOUBLE AS c, count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_totalprice <= 150000) + 0.5::DOUBLE AS d FROM orders)
SELECT 'cohens_d' AS measure, round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 9) AS value FROM a, b
UNION ALL SELECT 'eta_squared', round(((SELECT sum(s * s / n) FROM p) - s * s / n) / (q - s * s / n), 9) FROM w
UNION ALL SELECT 'odds_ratio', round(a * d / (b * c), 9) FROM c
"""


def survival(spark: SparkSession, d: str) -> DataFrame:
    """Days from order to shipment; lines not yet delivered are censored."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    days = l.join(o, l.l_orderkey == o.o_orderkey).select("l_linestatus", "l_returnflag", F.datediff("l_shipdate", "o_orderdate").alias("days")).where("days >= 0")
    found = stats.kaplan_meier(days, "days", F.col("l_linestatus") == "F", ["l_returnflag"])
    return found.select("l_returnflag", "time", "at_risk", "deaths", F.round("survival", 6).alias("survival"))


SURVIVAL_SQL = """
WITH x AS (SELECT l_returnflag, l_linestatus, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS time FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
t AS (SELECT l_returnflag, time, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'F') AS deaths FROM x WHERE time >= 0 GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY time DESC)::BIGINT AS at_risk FROM t)
SELECT l_returnflag, time, at_risk, deaths, round(CASE WHEN max((deaths = at_risk)::INT) OVER w = 1 THEN 0 ELSE exp(coalesce(sum(CASE WHEN deaths < at_risk THEN ln(1 - deaths / at_risk::DOUBLE) END) OVER w, 0)) END, 6) AS survival
FROM r WHERE deaths > 0 WINDOW w AS (PARTITION BY l_returnflag ORDER BY time)
"""


def log_rank(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("t", F.floor("value"))
    kinds = F.col("user_id") % 2 == 0
    return stats.log_rank(e, "t", F.col("event_id") % 3 != 0, kinds).select(F.round("chi2", 6).alias("chi2"))


LOG_RANK_SQL = """
WITH t AS (SELECT floor(value) AS t, count(*) AS n, count(*) FILTER (WHERE user_id % 2 = 0) AS na, count(*) FILTER (WHERE event_id % 3 <> 0) AS d, count(*) FILTER (WHERE event_id % 3 <> 0 AND user_id % 2 = 0) AS da FROM events GROUP BY 1),
r AS (SELECT *, (sum(n) OVER (ORDER BY t DESC))::DOUBLE AS r, (sum(na) OVER (ORDER BY t DESC))::DOUBLE AS ra FROM t)
SELECT round(pow(sum(da - d * ra / r), 2) / sum(CASE WHEN r > 1 THEN d * ra / r * (1 - ra / r) * (r - d) / (r - 1) ELSE 0 END), 6) AS chi2 FROM r WHERE d > 0
"""


def multiple_comparisons(spark: SparkSession, d: str) -> DataFrame:
    """p-values of the days' departures from the mean number of events, corrected for their number."""
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    w = days.agg(F.avg("n").alias("m"), F.stddev_samp("n").alias("s"))
    p = days.join(F.broadcast(w)).select(F.col("day").cast("string").alias("day"), F.round(normal_tail((F.col("n") - F.col("m")) / F.col("s")), 9).alias("p"))
    return estimates.corrected(p, "p").select("day", "p", F.round("q", 9).alias("q"))


BH_SQL = f"""
WITH c AS (SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1), z AS (SELECT day, abs((n - avg(n) OVER ()) / stddev_samp(n) OVER ()) AS z FROM c),
p AS (SELECT day, round({erfc_sql("(z / sqrt(2))")}, 9) AS p FROM z), r AS (SELECT *, count(*) OVER (ORDER BY p) AS r, count(*) OVER () AS n FROM p)
SELECT day, p, round(least(1.0, min(p * n / r) OVER (ORDER BY p DESC)), 9) AS q FROM r
"""


def mutual_information(spark: SparkSession, d: str) -> DataFrame:
    return stats.mutual_information(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("mi", 6).alias("mi"))


MI_SQL = """
WITH b AS (SELECT min(l_quantity) AS a0, max(l_quantity) AS a1, min(l_extendedprice) AS b0, max(l_extendedprice) AS b1 FROM lineitem),
c AS (SELECT least(9, floor((l_quantity - a0) / (a1 - a0) * 10)) AS i, least(9, floor((l_extendedprice - b0) / (b1 - b0) * 10)) AS j FROM lineitem, b),
n AS (SELECT i, j, count(*)::DOUBLE AS n FROM c GROUP BY 1, 2), t AS (SELECT n, sum(n) OVER (PARTITION BY i) AS r, sum(n) OVER (PARTITION BY j) AS c, sum(n) OVER () AS w FROM n)
SELECT round(sum(n / w * ln(n * w / (r * c))), 6) AS mi FROM t
"""


def regression(spark: SparkSession, d: str) -> DataFrame:
    found = stats.linear_regression(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([(k, round(v, 4)) for k, v in found.items()], "term string, value double")


REGRESSION_SQL = "SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS value FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem UNION ALL SELECT 'r2', round(regr_r2(l_extendedprice, l_quantity), 4) FROM lineitem"


def mahalanobis(spark: SparkSession, d: str) -> DataFrame:
    found = stats.mahalanobis(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], ridge=0.0)
    return found.where("distance > 2.3").select("l_orderkey", "l_linenumber", F.round("distance", 6).alias("distance"))


MAHALANOBIS_SQL = """
WITH s AS (SELECT avg(l_quantity) AS ma, avg(l_discount) AS mb, var_samp(l_quantity) AS va, var_samp(l_discount) AS vb, covar_samp(l_quantity, l_discount) AS c FROM lineitem),
x AS (SELECT l_orderkey, l_linenumber, l_quantity - ma AS a, l_discount - mb AS b, va, vb, c FROM lineitem, s),
y AS (SELECT l_orderkey, l_linenumber, sqrt((vb * a * a - 2 * c * a * b + va * b * b) / (va * vb - c * c)) AS d FROM x)
SELECT l_orderkey, l_linenumber, round(d, 6) AS distance FROM y WHERE d > 2.3
"""


def forecast_errors(spark: SparkSession, d: str) -> DataFrame:
    """RMSE, MAE and MAPE of a flat price forecast by status."""
    o = table(spark, d, "orders").join(table(spark, d, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("f")), "o_orderpriority")
    e = F.col("o_totalprice") - F.col("f")
    return o.groupBy("o_orderstatus").agg(F.round(F.sqrt(F.avg(e * e)), 2).alias("rmse"), F.round(F.avg(F.abs(e)), 2).alias("mae"), F.round(F.avg(F.when(F.col("o_totalprice") != 0, F.abs(e / F.col("o_totalprice")))), 6).alias("mape"))


def two_way_effects(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the sum of squares of daily values: by kind, by day, rest."""
    cells = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    g = cells.agg(F.avg("v")).first()[0]
    by = [cells.groupBy(k).agg(F.count("*").alias("n"), F.avg("v").alias("m")).agg(F.sum(F.col("n") * (F.col("m") - g) * (F.col("m") - g)).alias("ss")).select(F.lit(k).alias("part"), "ss") for k in ("event_type", "day")]
    total = cells.agg(F.sum((F.col("v") - g) * (F.col("v") - g))).first()[0]
    return by[0].unionByName(by[1]).select("part", F.round(F.col("ss") / total, 6).alias("share"))


TWO_WAY_SQL = """
WITH c AS (SELECT event_type, ts::DATE AS day, sum(value) AS v FROM events GROUP BY 1, 2), g AS (SELECT avg(v) AS g, sum(v * v) - count(*) * avg(v) * avg(v) AS t FROM c)
SELECT 'event_type' AS part, round(sum(n * (m - g) * (m - g)) / any_value(t), 6) AS share FROM (SELECT event_type, count(*) AS n, avg(v) AS m FROM c GROUP BY 1), g
UNION ALL SELECT 'day', round(sum(n * (m - g) * (m - g)) / any_value(t), 6) FROM (SELECT day, count(*) AS n, avg(v) AS m FROM c GROUP BY 1), g
"""


def _hours(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", F.date_trunc("hour", "ts").alias("h"))


def graph_measures(spark: SparkSession, d: str) -> DataFrame:
    """Degree of each user in the graph of users who share an hour."""
    return graphs.shared_degrees(_hours(spark, d), "user_id", "h").withColumnRenamed("node", "user_id")


def triangles(spark: SparkSession, d: str) -> DataFrame:
    """How many triples of users share an hour, two and two."""
    return spark.createDataFrame([(graphs.shared_triangles(_hours(spark, d), "user_id", "h"),)], "n long")


_EDGE = "WITH e AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS h FROM events), g AS (SELECT DISTINCT x.user_id AS a, y.user_id AS b FROM e x JOIN e y USING (h) WHERE x.user_id < y.user_id)"


def value_at_risk(spark: SparkSession, d: str) -> DataFrame:
    """The 5 % quantile of the account balance by rank, and the mean of what lies at or under it."""
    c = table(spark, d, "customer").select("c_mktsegment", "c_acctbal")
    w = Window.partitionBy("c_mktsegment")
    ranked = c.withColumn("r", F.row_number().over(w.orderBy("c_acctbal"))).withColumn("n", F.count("*").over(w))
    return ranked.where(F.col("r") <= F.floor(0.05 * F.col("n")) + 1).groupBy("c_mktsegment").agg(F.max("c_acctbal").alias("var"), F.round(F.avg("c_acctbal"), 4).alias("cvar"))


VAR_SQL = "WITH r AS (SELECT c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_mktsegment, max(c_acctbal) AS var, round(avg(c_acctbal), 4) AS cvar FROM r WHERE r <= floor(0.05::DOUBLE * n) + 1 GROUP BY 1"

QUERIES = {
    "pricing_summary": (pricing_summary, "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"),
    "correlation_pairs": (correlation_pairs, CORR_SQL),
    "spearman": (spearman, SPEARMAN_SQL),
    "histogram": (histogram, "WITH b AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders) SELECT least(9, floor((o_totalprice - a) / (b - a) * 10))::INT AS bin, count(*) AS n FROM orders, b GROUP BY 1"),
    "robust_anomalies": (robust_anomalies, ROBUST_SQL),
    "threshold_sweep": (threshold_sweep, SWEEP_SQL),
    "effect_sizes": (effect_sizes, EFFECT_SQL),
    "survival_kaplan_meier": (survival, SURVIVAL_SQL),
    "survival_log_rank": (log_rank, LOG_RANK_SQL),
    "benjamini_hochberg": (multiple_comparisons, BH_SQL),
    "mutual_information": (mutual_information, MI_SQL),
    "linear_regression": (regression, REGRESSION_SQL),
    "mahalanobis": (mahalanobis, MAHALANOBIS_SQL),
    "forecast_errors": (forecast_errors, "WITH f AS (SELECT o_orderpriority, avg(o_totalprice) AS f FROM orders GROUP BY 1) SELECT o_orderstatus, round(sqrt(avg((o_totalprice - f) * (o_totalprice - f))), 2) AS rmse, round(avg(abs(o_totalprice - f)), 2) AS mae, round(avg(CASE WHEN o_totalprice <> 0 THEN abs((o_totalprice - f) / o_totalprice) END), 6) AS mape FROM orders JOIN f USING (o_orderpriority) GROUP BY 1"),
    "two_way_effects": (two_way_effects, TWO_WAY_SQL),
    "graph_degree": (graph_measures, _EDGE + " SELECT user_id, count(*) AS degree FROM (SELECT a AS user_id FROM g UNION ALL SELECT b FROM g) GROUP BY 1"),
    "graph_triangles": (triangles, _EDGE + " SELECT count(*) AS n FROM g x JOIN g y ON x.b = y.a JOIN g z ON z.a = x.a AND z.b = y.b"),
    "value_at_risk": (value_at_risk, VAR_SQL),
}
