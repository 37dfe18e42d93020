"""Queries that rank findings against a question, and rows by several figures."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators import ranking
from sparkloom.sources import table

QUESTION = "Why is there a weird spike in purchase, was it stable before?"


def _findings(spark: SparkSession, d: str) -> DataFrame:
    """A finding for each kind of event and day: how far its count lies from the kind's mean."""
    days = table(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    g = Window.partitionBy("event_type")
    z = F.round((F.col("n") - F.avg("n").over(g)) / F.stddev_pop("n").over(g), 6)
    rows = days.withColumn("z", z)
    size = F.abs("z")
    title = F.when(size > 2, F.concat(F.lit("Anomaly spike in "), "event_type")).when(F.col("z") > 1, F.concat(F.lit("Regime shift of "), "event_type")).when(F.col("z") < -1, F.concat(F.lit("Forecast for "), "event_type"))
    return rows.select(
        F.concat_ws(":", "event_type", "day").alias("finding"),
        F.coalesce(title, F.concat(F.lit("Steady counts of "), "event_type")).alias("title"),
        F.concat(F.lit("Counts of "), "event_type", F.lit(" on "), "day").alias("description"),
        F.lit("daily z").alias("method"),
        F.least(F.lit(1.0), size / 3).alias("confidence"),
        F.when(size > 2.5, "crit").when(size > 1.5, "warn").when(size > 0.5, "info").otherwise("ok").alias("severity"),
        F.col("event_type").alias("label"),
        F.when(size > 0.1, F.col("z")).alias("z"),
        F.when(size > 2, "novel").when(size > 1, "confirmed").alias("status"),
    )


def findings_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The findings most relevant to a question, and the most surprising of the others."""
    found = ranking.two_lists(_findings(spark, d), QUESTION, "finding")
    return found.select("list", "rank", F.col("key").alias("finding"), F.round("score", 6).alias("score"))


def findings_scored(spark: SparkSession, d: str) -> DataFrame:
    """Relevance and surprise of every finding."""
    return ranking.scored(_findings(spark, d), QUESTION).select("finding", F.round("relevance", 6).alias("relevance"), F.round("surprise", 6).alias("surprise"))


def _listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_OWN = [w for w in re.findall("[a-z0-9]+", QUESTION.lower()) if len(w) > 1 and w not in ranking.STOP]
_SCORES = f"""
c AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2),
f AS (
  SELECT event_type || ':' || day AS finding, event_type AS label, day,
    round((n - avg(n) OVER (PARTITION BY event_type)) / stddev_pop(n) OVER (PARTITION BY event_type), 6) AS z FROM c),
t AS (
  SELECT *, least(1, abs(z) / 3) AS confidence,
    CASE WHEN abs(z) > 2.5 THEN 1.0 WHEN abs(z) > 1.5 THEN 0.7 WHEN abs(z) > 0.5 THEN 0.4 ELSE 0.2 END AS severity,
    CASE WHEN abs(z) > 2 THEN 'anomaly spike in ' WHEN z > 1 THEN 'regime shift of ' WHEN z < -1 THEN 'forecast for ' ELSE 'steady counts of ' END || label AS title FROM f),
w AS (
  SELECT *, list_distinct(list_filter(regexp_split_to_array(title || ' counts of ' || label || ' on ' || day || ' daily z', '[^a-z0-9]+'),
    lambda x: length(x) > 1 AND NOT list_contains({_listed(ranking.STOP)}, x))) AS words,
    {_listed(sorted({*_OWN, 'anomaly', *ranking.KINDS['anomaly']}))} AS asked FROM t),
j AS (SELECT *, len(list_intersect(words, asked))::DOUBLE / len(list_distinct(list_concat(words, asked))) AS shared FROM w),
r AS (
  SELECT *, 0.4 * CASE WHEN shared > 0 THEN shared WHEN list_bool_or([contains(array_to_string(words, ' '), x) FOR x IN {_listed(_OWN)}]) THEN 0.15 ELSE 0 END
    + 0.25 * (starts_with(title, 'anomaly'))::INT + 0.15 * confidence
    + 0.1 * CASE WHEN contains('{QUESTION.lower()}', label) THEN 1 WHEN len(list_intersect(regexp_split_to_array(label, '[^a-z0-9]+'), {_listed(re.findall("[a-z0-9]+", QUESTION.lower()))})) > 0 THEN 0.7 ELSE 0 END
    + 0.1 * severity AS relevance FROM j),
s AS (
  SELECT finding, relevance, 0.4 * CASE WHEN abs(z) > 0.1 THEN least(1, abs(z) / 5) ELSE severity END + 0.25 * greatest(0, 1 - relevance)
    + 0.2 * CASE WHEN NOT starts_with(title, 'forecast') THEN 1 ELSE 0.3 END
    + 0.1 * CASE WHEN abs(z) > 2 THEN 1 ELSE 0.3 END + 0.05 * confidence AS surprise FROM r)"""
SCORED_SQL = f"WITH {_SCORES} SELECT finding, round(relevance, 6) AS relevance, round(surprise, 6) AS surprise FROM s"
RANKED_SQL = f"""
WITH {_SCORES},
a AS (SELECT finding, round(relevance, 9) AS score, row_number() OVER (ORDER BY round(relevance, 9) DESC, finding) AS rank FROM s WHERE round(relevance, 9) >= 0.3 QUALIFY rank <= 8),
b AS (
  SELECT finding, round(surprise, 9) AS score, row_number() OVER (ORDER BY round(surprise, 9) DESC, finding) AS rank
  FROM s WHERE round(surprise, 9) >= 0.5 AND finding NOT IN (SELECT finding FROM a) QUALIFY rank <= 5)
SELECT 'relevant' AS list, rank::INT AS rank, finding, round(score, 6) AS score FROM a
UNION ALL SELECT 'surprise', rank::INT, finding, round(score, 6) FROM b"""


def pareto_levels(spark: SparkSession, d: str) -> DataFrame:
    """The first three levels of parts that are large and dear."""
    return ranking.levels(table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"]).select(F.col("key").alias("p_partkey"), "level")


def _levels_sql(source: str, key: str, figures: list[str], most: int = 3) -> str:
    """Non-dominated rows level by level, as anti joins."""
    no_worse = " AND ".join(f"b.{f} >= a.{f}" for f in figures)
    better = " OR ".join(f"b.{f} > a.{f}" for f in figures)
    parts, rest = [f"r0 AS ({source})"], "r0"
    for k in range(1, most + 1):
        parts += [
            f"l{k} AS (SELECT * FROM {rest} a WHERE NOT EXISTS (SELECT 1 FROM {rest} b WHERE {no_worse} AND ({better})))",
            f"r{k} AS (SELECT * FROM {rest} WHERE {key} NOT IN (SELECT {key} FROM l{k}))",
        ]
        rest = f"r{k}"
    return "WITH " + ",\n".join(parts) + "\n" + " UNION ALL ".join(f"SELECT {key}, {k} AS level FROM l{k}" for k in range(1, most + 1))


def pareto_many(spark: SparkSession, d: str) -> DataFrame:
    """The first two levels of parts by four figures: low price and discount, high quantity and size."""
    # means are cleared of what the order of summing leaves before they are rounded, so that halves go up whatever the order
    sold = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").cast("long").alias("quantity"), F.round(F.round(F.avg("l_discount"), 12), 3).alias("discount"))
    rows = table(spark, d, "part").join(sold, "p_partkey").select("p_partkey", (-F.col("p_retailprice")).alias("price"), (-F.col("discount")).alias("discount"), "quantity", "p_size")
    return ranking.levels(rows, "p_partkey", ["price", "discount", "quantity", "p_size"], 2).select(F.col("key").alias("p_partkey"), "level")


_SOLD = """SELECT p_partkey, -p_retailprice AS price, -discount AS discount, quantity, p_size FROM part JOIN
  (SELECT l_partkey, sum(l_quantity)::BIGINT AS quantity, round(avg(l_discount), 3) AS discount FROM lineitem GROUP BY 1) ON l_partkey = p_partkey"""


def weighted_rank(spark: SparkSession, d: str) -> DataFrame:
    """The ten best parts by one weighted figure of price and size, low first."""
    score = ranking.weighted(["p_retailprice", "p_size"], {"p_retailprice": 1.0, "p_size": 3.0})
    return table(spark, d, "part").select("p_partkey", F.round(score, 6).alias("score")).orderBy("score", "p_partkey").limit(10)


QUERIES = {
    "findings_ranked": (findings_ranked, RANKED_SQL),
    "findings_scored": (findings_scored, SCORED_SQL),
    "pareto_levels": (pareto_levels, _levels_sql("SELECT p_partkey, p_size, p_retailprice FROM part", "p_partkey", ["p_size", "p_retailprice"])),
    "pareto_many_figures": (pareto_many, _levels_sql(_SOLD, "p_partkey", ["price", "discount", "quantity", "p_size"], 2)),
    "weighted_rank": (weighted_rank, "SELECT p_partkey, round(0.25 * p_retailprice + 0.75 * p_size, 6) AS score FROM part ORDER BY score, p_partkey LIMIT 10"),
}
