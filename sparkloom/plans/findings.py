"""Queries on findings: rows that say what an analysis found, compared, ranked and decided upon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.sources import table


def findings(spark: SparkSession, d: str, until: str) -> DataFrame:
    """One finding for each kind of event and day whose count departs from the kind's mean."""
    days = table(spark, d, "events").where(F.col("ts") < F.lit(until).cast("timestamp")).groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))
    g = Window.partitionBy("event_type")
    z = days.withColumn("z", F.round((F.col("n") - F.avg("n").over(g)) / F.stddev_pop("n").over(g), 6)).where("abs(z) >= 1")
    severity = F.when(F.abs("z") >= 2, "crit").when(F.abs("z") >= 1.5, "warn").otherwise("info")
    return z.select("event_type", "day", "z", severity.alias("severity"), F.least(F.lit(1.0), F.abs("z") / 3).alias("confidence"))


_F = "SELECT *, CASE WHEN abs(z) >= 2 THEN 'crit' WHEN abs(z) >= 1.5 THEN 'warn' ELSE 'info' END AS severity, least(1.0, abs(z) / 3) AS confidence FROM (SELECT event_type, day, round((n - avg(n) OVER g) / stddev_pop(n) OVER g, 6) AS z FROM (SELECT event_type, strftime(ts::DATE, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts < TIMESTAMP '{}' GROUP BY 1, 2) WINDOW g AS (PARTITION BY event_type)) WHERE abs(z) >= 1"
_A, _B = "2024-01-20 00:00:00", "2024-02-01 00:00:00"


def by_severity(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d, _B).groupBy("severity").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


def compared_runs(spark: SparkSession, d: str) -> DataFrame:
    """Findings of two runs: new, gone, and for those in both whether they got stronger or weaker."""
    a = findings(spark, d, _A).select("event_type", "day", F.col("z").alias("za"))
    b = findings(spark, d, _B).select("event_type", "day", F.col("z").alias("zb"))
    status = F.when(F.col("za").isNull(), "new").when(F.col("zb").isNull(), "gone").when(F.signum("za") != F.signum("zb"), "contradicted").when(F.abs("zb") > F.abs("za") * 1.1, "strengthened").when(F.abs("zb") < F.abs("za") * 0.9, "weakened").otherwise("confirmed")
    return a.join(b, ["event_type", "day"], "full_outer").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


COMPARED_SQL = f"WITH a AS ({_F.format(_A)}), b AS ({_F.format(_B)}), j AS (SELECT a.z AS za, b.z AS zb FROM a FULL JOIN b USING (event_type, day)) SELECT CASE WHEN za IS NULL THEN 'new' WHEN zb IS NULL THEN 'gone' WHEN sign(za) <> sign(zb) THEN 'contradicted' WHEN abs(zb) > abs(za) * 1.1 THEN 'strengthened' WHEN abs(zb) < abs(za) * 0.9 THEN 'weakened' ELSE 'confirmed' END AS status, count(*) AS n FROM j GROUP BY 1"


def decision(spark: SparkSession, d: str) -> DataFrame:
    """Contracts over the findings: which predicates hold."""
    f = findings(spark, d, _B)
    totals = f.agg(F.count("*").alias("count"), F.count_if(F.col("severity") == "crit").alias("crit"), F.max("confidence").alias("confidence"), F.count_distinct("event_type").alias("kinds"))
    rules = {"any_crit": F.col("crit") > 0, "many": F.col("count") >= 30, "sure": F.col("confidence") >= 0.8, "broad": F.col("kinds").between(3, 10)}
    return totals.select(F.explode(F.array(*[F.struct(F.lit(k).alias("contract"), c.alias("satisfied")) for k, c in rules.items()])).alias("r")).select("r.*")


DECISION_SQL = f"WITH t AS (SELECT count(*) AS n, count(*) FILTER (WHERE severity = 'crit') AS crit, max(confidence) AS c, count(DISTINCT event_type) AS k FROM ({_F.format(_B)})) SELECT 'any_crit' AS contract, crit > 0 AS satisfied FROM t UNION ALL SELECT 'many', n >= 30 FROM t UNION ALL SELECT 'sure', c >= 0.8 FROM t UNION ALL SELECT 'broad', k BETWEEN 3 AND 10 FROM t"


def smoothed_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of urgent orders by segment: Beta(1, 1) means, and means drawn to the overall rate with the weight of four cases."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    each = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("hits"))
    base = F.sum("hits").over(Window.partitionBy()) / F.sum("n").over(Window.partitionBy())
    return each.select("c_mktsegment", F.round((F.col("hits") + 1) / (F.col("n") + 2), 9).alias("beta"), F.round((F.col("hits") + 4 * base) / (F.col("n") + 4), 9).alias("drawn"))


RATES_SQL = "WITH e AS (SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS hits FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT c_mktsegment, round((hits + 1)::DOUBLE / (n + 2), 9) AS beta, round((hits + 4 * sum(hits) OVER ()::DOUBLE / sum(n) OVER ()) / (n + 4), 9) AS drawn FROM e"


def by_month(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(F.coalesce(F.date_format("o_orderdate", "yyyy-MM"), F.lit("unknown")).alias("month")).agg(F.count("*").alias("n"))


def candidate_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Combinations of two columns by their coefficient of variation, the steadiest first."""
    l = table(spark, d, "lineitem")
    a, b = F.col("l_extendedprice"), F.col("l_quantity")
    forms = {"x + y": a + b, "x - y": a - b, "x * y": a * b, "x / y": F.when(b != 0, a / b)}
    parts = [F.struct(F.lit(k).alias("form"), F.round(F.stddev_samp(e) / F.abs(F.avg(e)), 6).alias("cv")) for k, e in forms.items()]
    return l.agg(F.array(*parts).alias("p")).select(F.inline("p"))


_INV = " UNION ALL ".join(f"SELECT '{k}' AS form, round(stddev_samp({e}) / abs(avg({e})), 6) AS cv FROM lineitem" for k, e in (("x + y", "l_extendedprice + l_quantity"), ("x - y", "l_extendedprice - l_quantity"), ("x * y", "l_extendedprice * l_quantity"), ("x / y", "l_extendedprice / nullif(l_quantity, 0)")))

QUERIES = {
    "findings": (lambda spark, d: findings(spark, d, _B), _F.format(_B)),
    "findings_by_severity": (by_severity, f"SELECT severity, count(*) AS n, round(avg(confidence), 6) AS confidence FROM ({_F.format(_B)}) GROUP BY 1"),
    "findings_compared": (compared_runs, COMPARED_SQL),
    "decision_contracts": (decision, DECISION_SQL),
    "smoothed_rates": (smoothed_rates, RATES_SQL),
    "counts_by_month": (by_month, "SELECT coalesce(strftime(o_orderdate, '%Y-%m'), 'unknown') AS month, count(*) AS n FROM orders GROUP BY 1"),
    "candidate_invariants": (candidate_invariants, _INV),
}
