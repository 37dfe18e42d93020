"""Queries on how far results hold, and on tables kept by their changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import registry, robustness
from sparkloom.operators.nearest import nearest
from sparkloom.plans.forecasts import H, _methods_sql
from sparkloom.plans.series import _DAYS, _days
from sparkloom.sources import table

RUNS, ORIGINS = 40, 2


def perturbed_bands(spark: SparkSession, d: str) -> DataFrame:
    """What the mean price and the correlation of price and size of parts do when both are perturbed by 2 %."""
    found = robustness.ensemble(table(spark, d, "part"), "p_partkey", ["p_retailprice", "p_size"], {"mean": F.avg("p_retailprice"), "r": F.corr("p_retailprice", "p_size")}, RUNS)
    return found.select("figure", *[F.round(c, 5).alias(c) for c in (*robustness.SHARES, "mean", "sd")])


_U = "(('0x' || substr(md5('7:' || run || ':{c}:' || p_partkey || ':{t}'), 1, 8))::BIGINT / 4294967296.0)"


def _noised(c: str) -> str:
    return f"{c} * (1 + 0.02 * (sqrt(-2 * ln(1 - {_U.format(c=c, t='r')})) * cos(2 * pi() * {_U.format(c=c, t='a')})))"


ENSEMBLE_SQL = f"""
WITH p AS (SELECT run, {_noised("p_retailprice")} AS x, {_noised("p_size")} AS y FROM part, (SELECT unnest(range(1, {RUNS + 1})) AS run)),
g AS (SELECT run, avg(x) AS m, corr(x, y) AS r FROM p GROUP BY 1),
l AS (SELECT 'mean' AS figure, m AS x FROM g UNION ALL SELECT 'r', r FROM g)
SELECT figure, {", ".join(f"round(quantile_cont(x, {p}), 5) AS {n}" for n, p in robustness.SHARES.items())}, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS sd FROM l GROUP BY 1"""


def weight_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """What the mean risk of events does when one of its two weights is moved."""
    groups = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("a"), F.max("value").alias("m"))
    risk = lambda w: F.avg(F.col("n") * (w["average"] * F.col("a") + w["highest"] * F.col("m")))
    found = robustness.weight_changes(groups, {"average": 0.5, "highest": 0.5}, risk)
    return found.select("weight", "change", F.round("base", 5).alias("base"), F.round("delta", 5).alias("delta"))


WEIGHTS_SQL = """
WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS a, max(value) AS m FROM events GROUP BY 1),
c AS (SELECT unnest([-0.2, -0.1, 0.1, 0.2])::DOUBLE AS change), b AS (SELECT avg(n * (0.5 * a + 0.5 * m)) AS base FROM g)
SELECT 'average' AS weight, change, round(any_value(base), 5) AS base, round(avg(n * 0.5 * change * a), 5) AS delta FROM g, c, b GROUP BY 2
UNION ALL SELECT 'highest', change, round(any_value(base), 5), round(avg(n * 0.5 * change * m), 5) FROM g, c, b GROUP BY 2"""


def forecast_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Errors of the methods over two rolling origins of a week."""
    found = robustness.rolling_errors(_days(spark, d), ["event_type"], ["day"], "v", H, ORIGINS)
    return found.select("event_type", "method", "origins", F.round("rmse", 3).alias("rmse"))


ROLLING_SQL = f"""
WITH {_DAYS},
p AS (SELECT event_type, row_number() OVER w AS i, count(*) OVER (PARTITION BY event_type) AS n, v AS x FROM days WINDOW w AS (PARTITION BY event_type ORDER BY day)),
q AS (SELECT event_type || '|' || o AS event_type, i, n - o * {H} AS stop, x FROM p, (SELECT unnest(range(1, {ORIGINS + 1})) AS o) WHERE n - o * {H} >= {2 * H}),
{_methods_sql("SELECT event_type, i, stop AS n, x FROM q WHERE i <= stop", "z")},
held AS (SELECT event_type, i - stop AS h, x FROM q WHERE i > stop AND i <= stop + {H}),
e AS (SELECT event_type, method, sqrt(avg((x - value) ** 2)) AS e FROM fz JOIN held USING (event_type, h) GROUP BY 1, 2)
SELECT split_part(event_type, '|', 1) AS event_type, method, count(*) AS origins, round(avg(e), 3) AS rmse FROM e GROUP BY 1, 2"""


def shuffled_target(spark: SparkSession, d: str) -> DataFrame:
    """How much of a linear fit of line prices is left when the prices are dealt out anew."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("double").alias("quantity"), F.round(F.sum("l_extendedprice"), 2).cast("long").alias("price"))
    return robustness.shuffled_fit(l, "l_orderkey", "price", ["quantity"]).select("n", F.round("r2", 6).alias("r2"), F.round("r2_shuffled", 6).alias("r2_shuffled"))


_H = "('0x' || substr(md5('7:{}:' || l_orderkey || ':' || price), 1, 8))::BIGINT"
SHUFFLED_SQL = f"""
WITH l AS (SELECT l_orderkey, sum(l_quantity)::DOUBLE AS quantity, trunc(round(sum(l_extendedprice), 2))::BIGINT AS price FROM lineitem GROUP BY 1),
h AS (SELECT quantity, row_number() OVER (ORDER BY {_H.format("here")}, l_orderkey) AS i FROM l),
t AS (SELECT price, row_number() OVER (ORDER BY {_H.format("there")}, l_orderkey) AS i FROM l)
SELECT (SELECT count(*) FROM l) AS n, (SELECT round(corr(quantity, price) ** 2, 6) FROM l) AS r2, (SELECT round(corr(quantity, price) ** 2, 6) FROM h JOIN t USING (i)) AS r2_shuffled"""


def regressor_choice(spark: SparkSession, d: str) -> DataFrame:
    """Which regressor tells the price of a line best from its quantity and discount."""
    l = table(spark, d, "lineitem").withColumn("k", F.concat_ws(":", "l_orderkey", "l_linenumber"))
    return robustness.regressors(l, "k", "l_extendedprice", ["l_quantity", "l_discount"], trees=5).select("model", "n_train", "n_test", "best")


def newest_runs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("done", F.col("o_orderstatus") == "F")
    return registry.newest(o, "done", "o_orderdate", "o_orderkey").select("o_orderkey", "o_totalprice")


def pinned_runs(spark: SparkSession, d: str) -> DataFrame:
    """Users' five last pins, events taken as pins of their kind with a note here and there."""
    e = table(spark, d, "events").select("user_id", "event_type", "ts", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("n"), "event_id")).alias("note"))
    found = registry.pins(e, "user_id", "event_type", "ts", "note", 3)
    return found.select("user_id", "event_type", F.unix_micros("at").alias("pinned_at"), "note", "place")


PINNED_SQL = """
WITH g AS (
  SELECT user_id, event_type, max(ts) AS pinned, (max({'t': ts, 'n': 'n' || event_id}) FILTER (event_id % 3 = 0)).n AS note FROM events GROUP BY 1, 2)
SELECT user_id, event_type, epoch_us(pinned) AS pinned_at, note, (row_number() OVER w)::INT AS place FROM g
WINDOW w AS (PARTITION BY user_id ORDER BY pinned DESC, event_type) QUALIFY place <= 3"""


def vectors_after_changes(spark: SparkSession, d: str) -> DataFrame:
    """The two nearest vectors after every seventh was removed and every eleventh turned round."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    changes = e.select("vec_id", F.lit(1).alias("at"), "v").unionByName(e.where("vec_id % 7 = 0").select("vec_id", F.lit(2).alias("at"), F.lit(None).cast("array<double>").alias("v")))
    changes = changes.unionByName(e.where("vec_id % 11 = 0").select("vec_id", F.lit(3).alias("at"), F.reverse("v").alias("v")))
    found = nearest(e.where("vec_id % 100 = 0"), registry.live(changes, "vec_id", "at", "v"), "vec_id", "v", 2, itself=True)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"))


VECTORS_SQL = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
l AS (SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN list_reverse(v) ELSE v END AS v FROM e WHERE vec_id % 7 <> 0 OR vec_id % 11 = 0),
s AS (SELECT q.vec_id AS query_id, l.vec_id, round(list_cosine_similarity(q.v, l.v), 9) AS s FROM e q, l WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, round(s, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 2"""

QUERIES = {
    "perturbed_bands": (perturbed_bands, ENSEMBLE_SQL),
    "weight_sensitivity": (weight_sensitivity, WEIGHTS_SQL),
    "forecast_rolling": (forecast_rolling, ROLLING_SQL),
    "shuffled_target": (shuffled_target, SHUFFLED_SQL),
    "regressor_choice": (regressor_choice, None),
    "newest_runs": (newest_runs, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50"),
    "pinned_runs": (pinned_runs, PINNED_SQL),
    "vectors_after_changes": (vectors_after_changes, VECTORS_SQL),
}
