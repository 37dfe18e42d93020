"""Queries on schema, quality, predicates and constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators import profile
from sparkloom.sources import table


def profile_orders(spark: SparkSession, d: str) -> DataFrame:
    found = profile.profile(table(spark, d, "orders"))
    return found.select("column", "n_total", "n_missing", F.round("completeness", 6).alias("completeness"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.round("min", 4).alias("min"), F.round("max", 4).alias("max"))


_NUMBERS = ("o_orderkey", "o_custkey", "o_totalprice")
_OTHERS = ("o_orderstatus", "o_orderdate", "o_orderpriority")
PROFILE_SQL = " UNION ALL ".join(
    [f"SELECT '{c}' AS \"column\", count(*) AS n_total, count(*) - count({c}) AS n_missing, round(1.0 - (count(*) - count({c})) / count(*), 6)::DOUBLE AS completeness, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std, round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max FROM orders" for c in _NUMBERS]
    + [f"SELECT '{c}', count(*), count(*) - count({c}), round(1.0 - (count(*) - count({c})) / count(*), 6)::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM orders" for c in _OTHERS]
)


def column_roles(spark: SparkSession, d: str) -> DataFrame:
    return profile.roles(profile.profile(table(spark, d, "events"))).select("column", "role")


def value_types(spark: SparkSession, d: str) -> DataFrame:
    return profile.value_types(table(spark, d, "orders"), ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"]).select("column", "type", "n_other")


def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    found = profile.violations(table(spark, d, "lineitem"), {"l_discount": (0.0, 0.05), "l_quantity": (1.0, None), "l_tax": (None, 0.08)})
    return found.select("column", "n_violations", F.round("fraction", 9).alias("fraction"), "lowest", "highest", "severity")


def _violation_sql(c: str, outside: str) -> str:
    return f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {outside}) AS n_violations, round((count(*) FILTER (WHERE {outside}))::DOUBLE / count({c}), 9) AS fraction, min({c}) AS lowest, max({c}) AS highest FROM lineitem"


VIOLATION_SQL = "SELECT *, CASE WHEN n_violations = 0 THEN 'ok' WHEN fraction < 0.01 THEN 'warn' ELSE 'fail' END AS severity FROM (" + " UNION ALL ".join([_violation_sql("l_discount", "l_discount < 0 OR l_discount > 0.05"), _violation_sql("l_quantity", "l_quantity < 1"), _violation_sql("l_tax", "l_tax > 0.08")]) + ")"


def constraint_projection(spark: SparkSession, d: str) -> DataFrame:
    found = profile.clamped(table(spark, d, "lineitem"), {"l_discount": (0.02, 0.05), "l_quantity": (None, 30.0)})
    return found.groupBy("l_returnflag").agg(F.round(F.sum("l_discount"), 4).alias("discounts"), F.round(F.sum("l_quantity"), 4).alias("quantities"))


def missing_labels(spark: SparkSession, d: str) -> DataFrame:
    """Missing values of a left join, by column, the most missing first."""
    joined = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    rates = joined.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in joined.columns])
    return rates.unpivot([], rates.columns, "column", "missing").select("column", F.round("missing", 9).alias("missing"))


def missing_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Runs of three or more neighbouring documents of a source without a label."""
    joined = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    w = Window.partitionBy("source").orderBy("doc_id")
    rows = joined.select("source", "doc_id", F.col("quality").isNull().alias("gone"), F.row_number().over(w).alias("n"))
    rows = rows.withColumn("island", F.col("n") - F.row_number().over(Window.partitionBy("source", "gone").orderBy("doc_id")))
    return rows.where("gone").groupBy("source", "island").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("length")).where("length >= 3").select("source", "first_id", "last_id", "length")


BLOCK_SQL = """
WITH j AS (SELECT d.source, d.doc_id, l.quality IS NULL AS gone, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS n FROM documents d LEFT JOIN labels l USING (doc_id)),
i AS (SELECT *, n - row_number() OVER (PARTITION BY source, gone ORDER BY doc_id) AS island FROM j)
SELECT source, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) AS length FROM i WHERE gone GROUP BY source, island HAVING count(*) >= 3
"""


def sampling_regularity(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between a user's events: median, mean, spread and whether they are regular."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gaps = table(spark, d, "events").withColumn("gap", (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 1e6).where("gap IS NOT NULL")
    found = gaps.groupBy("user_id").agg(F.count("*").alias("n"), F.median("gap").alias("median"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"), F.max("gap").alias("longest"))
    cv = F.col("sd") / F.col("mean")
    kind = F.when(F.col("longest") > 10 * F.col("median"), "gaps").when(cv < 0.05, "regular").when(cv < 0.5, "mild").otherwise("irregular")
    return found.select("user_id", "n", F.round("median", 3).alias("median"), F.round("mean", 3).alias("mean"), F.round(cv, 6).alias("cv"), kind.alias("kind"))


REGULAR_SQL = """
WITH g AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap FROM events),
a AS (SELECT user_id, count(*) AS n, median(gap) AS median, avg(gap) AS mean, stddev_pop(gap) AS sd, max(gap) AS longest FROM g WHERE gap IS NOT NULL GROUP BY user_id)
SELECT user_id, n, round(median, 3) AS median, round(mean, 3) AS mean, round(sd / mean, 6) AS cv,
       CASE WHEN longest > 10 * median THEN 'gaps' WHEN sd / mean < 0.05 THEN 'regular' WHEN sd / mean < 0.5 THEN 'mild' ELSE 'irregular' END AS kind FROM a
"""


def daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events and their value for each day, empty days included."""
    events = table(spark, d, "events").select(F.to_date("ts").alias("day"), "value")
    span = events.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    days = events.groupBy("day").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return span.join(days, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


DAILY_SQL = """
WITH e AS (SELECT ts::DATE AS day, value FROM events),
s AS (SELECT unnest(generate_series((SELECT min(day) FROM e)::TIMESTAMP, (SELECT max(day) FROM e)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day)
SELECT strftime(s.day, '%Y-%m-%d') AS day, count(e.day) AS n, round(coalesce(sum(value), 0), 2) AS total FROM s LEFT JOIN e USING (day) GROUP BY s.day
"""


def filter_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Conjunctions of equality, membership, range and pattern."""
    o = table(spark, d, "orders")
    return o.where(F.col("o_orderstatus").isin("F", "P") & (F.col("o_totalprice") > 100000) & F.lower("o_orderpriority").contains("urgent")).select("o_orderkey", "o_orderstatus", "o_totalprice")


def na_tokens_masked(spark: SparkSession, d: str) -> DataFrame:
    """Medians after masking of missing-value tokens and imputation by the median."""
    o = table(spark, d, "orders").withColumn("x", F.when(F.col("o_orderkey") % 7 == 0, F.lit("N/A")).otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string")))
    x = F.when(~F.lower(F.trim("x")).isin(*profile.NA_TOKENS), F.col("x")).try_cast("double")
    o = o.select("o_orderstatus", x.alias("x"))
    middle = o.groupBy("o_orderstatus").agg(F.median("x").alias("m"))
    filled = o.join(middle, "o_orderstatus").withColumn("x", F.coalesce("x", "m"))
    return filled.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("x"), 2).alias("mean"))


NA_SQL = """
WITH o AS (SELECT o_orderstatus, CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice, 2) END AS x FROM orders),
m AS (SELECT o_orderstatus, median(x) AS m FROM o GROUP BY 1)
SELECT o_orderstatus, count(*) AS n, round(avg(coalesce(x, m)), 2) AS mean FROM o JOIN m USING (o_orderstatus) GROUP BY 1
"""

QUERIES = {
    "profile_orders": (profile_orders, PROFILE_SQL),
    "column_roles": (column_roles, "SELECT * FROM (VALUES ('event_id', 'id_like'), ('ts', 'datetime'), ('user_id', 'id_like'), ('event_type', 'categorical'), ('value', 'numeric'), ('props', (SELECT CASE WHEN count(DISTINCT props) <= 200 AND count(DISTINCT props) < 0.2 * count(*) THEN 'categorical' ELSE 'free_text' END FROM events))) t(\"column\", role)"),
    "value_types": (value_types, "SELECT * FROM (VALUES ('o_orderkey', 'integer', 0), ('o_totalprice', 'float', 0), ('o_orderstatus', 'string', 0), ('o_orderpriority', 'string', 0)) t(\"column\", type, n_other)"),
    "constraint_violations": (constraint_violations, VIOLATION_SQL),
    "constraint_projection": (constraint_projection, "SELECT l_returnflag, round(sum(greatest(0.02, least(0.05, l_discount))), 4) AS discounts, round(sum(least(30.0, l_quantity)), 4) AS quantities FROM lineitem GROUP BY 1"),
    "missing_labels": (missing_labels, "SELECT u.\"column\", round(u.missing, 9) AS missing FROM (SELECT avg((doc_id IS NULL)::INT) AS doc_id, avg((source IS NULL)::INT) AS source, avg((quality IS NULL)::INT) AS quality, avg((toxic IS NULL)::INT) AS toxic FROM documents LEFT JOIN labels USING (doc_id)) UNPIVOT (missing FOR \"column\" IN (doc_id, source, quality, toxic)) u"),
    "missing_blocks": (missing_blocks, BLOCK_SQL),
    "sampling_regularity": (sampling_regularity, REGULAR_SQL),
    "daily_counts": (daily_counts, DAILY_SQL),
    "filter_predicates": (filter_predicates, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice > 100000 AND lower(o_orderpriority) LIKE '%urgent%'"),
    "na_tokens_masked": (na_tokens_masked, NA_SQL),
}
