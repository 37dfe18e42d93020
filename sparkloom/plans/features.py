"""Queries on derived features, rows that stand out and steady clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import features
from sparkloom.sources import table

_C = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
#: By variance, the largest first: as the table has them.
_TOP = ["l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def derived_features(spark: SparkSession, d: str) -> DataFrame:
    """What differences, z-scores, lags and ratios of line items have values, order by order."""
    found = features.derived(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber"], _C)
    return found.select("feature", "kind", "non_null", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


def _derived_sql() -> str:
    out = []
    for c in _TOP:
        lag = lambda k: f"lag({c}, {k}) OVER w"  # noqa: B023, E731
        for kind, value in (("d1", f"{c} - {lag(1)}"), ("d2", f"{c} - 2 * {lag(1)} + {lag(2)}"), ("z", c), ("lag1", lag(1))):
            figures = f"round(avg({c}), 4), round(stddev_samp({c}), 4)" if kind == "z" else "NULL::DOUBLE, NULL::DOUBLE"
            out.append(f"SELECT '{c}__{kind}' AS feature, '{kind}' AS kind, count(v) AS non_null, {figures} FROM (SELECT *, {value} AS v FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))")
    for i, a in enumerate(_TOP):
        for b in _TOP[i + 1 :]:
            out.append(f"SELECT '{a}__over__{b}', 'ratio', count({a} / nullif({b}, 0)), NULL::DOUBLE, NULL::DOUBLE FROM lineitem")
    out[0] = out[0].replace("round(avg", "round(avg", 1).replace("NULL::DOUBLE, NULL::DOUBLE", "NULL::DOUBLE AS mean, NULL::DOUBLE AS sd")
    return "\nUNION ALL ".join(out)


def row_contributors(spark: SparkSession, d: str) -> DataFrame:
    """The twenty orders that stand out most, and which of their figures make them do so."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"), F.max("l_extendedprice").alias("dearest"), F.round(F.sum("l_tax"), 4).alias("tax"))
    found = features.contributors(l, "l_orderkey", ["lines", "quantity", "dearest", "tax"], parts=3)
    return found.select(F.col("key").alias("l_orderkey"), F.round("score", 5).alias("score"), "place", "column", F.round("z", 5).alias("z"))


def _contributors_sql() -> str:
    names = ["lines", "quantity", "dearest", "tax"]
    rest = " UNION ALL ".join(f"SELECT l_orderkey, '{c}' AS col, {c}::DOUBLE AS x FROM o" for c in names)
    return f"""
WITH o AS (SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS quantity, max(l_extendedprice) AS dearest, round(sum(l_tax), 4) AS tax FROM lineitem GROUP BY 1),
x AS ({rest}),
m AS (SELECT col, median(x) AS m FROM x GROUP BY 1),
s AS (SELECT col, any_value(m) AS m, median(abs(x - m)) AS s FROM x JOIN m USING (col) GROUP BY 1),
z AS (SELECT l_orderkey, col, CASE WHEN s > 0 THEN abs(0.6745 * (x - m) / s) ELSE 0 END AS z FROM x JOIN s USING (col)),
t AS (SELECT l_orderkey, max(z) AS score FROM z GROUP BY 1 ORDER BY score DESC, l_orderkey LIMIT 20),
r AS (SELECT l_orderkey, score, col, z, row_number() OVER (PARTITION BY l_orderkey ORDER BY z DESC, col) AS place FROM t JOIN z USING (l_orderkey))
SELECT l_orderkey, round(score, 5) AS score, place::INT AS place, col AS "column", round(z, 5) AS z FROM r WHERE place <= 3"""


def cluster_stability(spark: SparkSession, d: str) -> DataFrame:
    """Whether three clusters of users by their events are the same on samples of the users."""
    u = table(spark, d, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("mean"))
    told = features.stability(u, "user_id", ["n", "mean"], 3, resamples=4)
    return spark.createDataFrame([(told["n"], told["resamples"], told.get("stability"), told["verdict"])], "n long, resamples int, stability double, verdict string")


QUERIES = {
    "derived_features": (derived_features, _derived_sql()),
    "row_contributors": (row_contributors, _contributors_sql()),
    "cluster_stability": (cluster_stability, None),
}
