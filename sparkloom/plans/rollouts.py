"""Queries on series carried forward and periods that series share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators import forecasting, rollouts
from sparkloom.plans.series import _DAYS, _days
from sparkloom.sources import table

H, HELD, PATHS = 12, 7, 200


def rollout_models(spark: SparkSession, d: str) -> DataFrame:
    """How well a random walk and an AR(1) tell the last week of each kind's daily values."""
    rows = forecasting.placed(_days(spark, d), ["event_type"], ["day"], "v")
    return rollouts.model_scores(rows, ["event_type"], HELD).select("event_type", "model", F.round("rmse", 4).alias("rmse"), F.round("score", 6).alias("score"))


def rollout_bands(spark: SparkSession, d: str) -> DataFrame:
    """Simulated bands of twelve days by the better of the two models."""
    found = rollouts.rollout(_days(spark, d), ["event_type"], ["day"], "v", H, PATHS, HELD)
    return found.select("event_type", "model", "h", *[F.round(c, 3).alias(c) for c in ("p05", "p50", "p95", "mean", "sd")])


def _fit_sql(rows: str, out: str) -> str:
    """Both models' figures of the rows of a CTE."""
    return f"""
b{out} AS (SELECT *, lag(x) OVER (PARTITION BY event_type ORDER BY i) AS b FROM {rows}),
p{out} AS (
  SELECT event_type, count(*) AS k, arg_max(x, i) AS last, coalesce(stddev_samp(x - b), 0) AS w,
    CASE WHEN count(*) < 20 OR coalesce(sum(b * b), 0) <= 1e-9 THEN 0.9 ELSE greatest(-0.99, least(0.99, sum(x * b) / sum(b * b))) END AS phi
  FROM b{out} GROUP BY 1),
fit{out} AS (
  SELECT event_type, any_value(last) AS last, any_value(phi) AS phi,
    CASE WHEN any_value(k) >= 3 AND any_value(w) > 1e-9 THEN any_value(w) ELSE 1 END AS s_walk,
    CASE WHEN any_value(k) >= 20 AND stddev_pop(x - phi * b) > 1e-9 THEN stddev_pop(x - phi * b) ELSE 1 END AS s_ar1
  FROM b{out} JOIN p{out} USING (event_type) GROUP BY 1)"""


_SCORES = f"""{_DAYS},
r AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, count(*) OVER (PARTITION BY event_type) AS n, v AS x FROM days),
t AS (SELECT * FROM r WHERE n <= {HELD + 10} OR i <= n - {HELD}),
{_fit_sql("t", "k")},
e AS (
  SELECT event_type, sqrt(avg((x - last) ** 2)) AS walk, sqrt(avg((x - last * phi ** (CASE WHEN n > {HELD + 10} THEN i - n + {HELD} ELSE i END)) ** 2)) AS ar, stddev_pop(x) AS sd
  FROM r JOIN fitk USING (event_type) WHERE n <= {HELD + 10} OR i > n - {HELD} GROUP BY 1),
m AS (
  SELECT event_type, 'ar1' AS model, ar AS rmse, -ar / (sd + 1e-9) AS score FROM e
  UNION ALL SELECT event_type, 'random_walk', walk, -walk / (sd + 1e-9) FROM e)"""
MODELS_SQL = f"WITH {_SCORES} SELECT event_type, model, round(rmse, 4) AS rmse, round(score, 6) AS score FROM m"
_U = "(('0x' || substr(md5('42:' || event_type || ':' || path || ':' || h || ':{}'), 1, 8))::BIGINT / 4294967296.0)"
BANDS_SQL = f"""
WITH {_SCORES}, {_fit_sql("r", "a")},
best AS (SELECT event_type, model FROM m QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY round(score, 9) DESC, model) = 1),
f AS (SELECT event_type, model, last, CASE WHEN model = 'ar1' THEN phi ELSE 1 END AS phi, CASE WHEN model = 'ar1' THEN s_ar1 ELSE s_walk END AS s FROM fita JOIN best USING (event_type)),
z AS (
  SELECT *, s * sqrt(-2 * ln(1 - {_U.format("r")})) * cos(2 * pi() * {_U.format("a")}) AS e
  FROM f, (SELECT unnest(range(1, {PATHS + 1})) AS path), (SELECT unnest(range(1, {H + 1})) AS h)),
w AS (
  SELECT a.event_type, a.model, a.h, a.path, any_value(a.last) * any_value(a.phi) ** a.h + sum(b.e * a.phi ** (a.h - b.h)) AS x
  FROM z a JOIN z b ON a.event_type = b.event_type AND a.path = b.path AND b.h <= a.h GROUP BY 1, 2, 3, 4)
SELECT event_type, model, h::INT AS h, round(quantile_cont(x, 0.05), 3) AS p05, round(quantile_cont(x, 0.5), 3) AS p50, round(quantile_cont(x, 0.95), 3) AS p95,
  round(avg(x), 3) AS mean, round(stddev_pop(x), 3) AS sd FROM w GROUP BY 1, 2, 3"""

STEPS = 20


def laws_stepped(spark: SparkSession, d: str) -> DataFrame:
    """Twenty Euler steps of three laws fitted to each kind's daily values (in thousands)."""
    w = Window.partitionBy("event_type").orderBy("day")
    x = F.col("v") / 1000
    rows = _days(spark, d).withColumns({"x": x, "y": F.lag(x).over(w), "z": F.lead(x).over(w), "c": x - F.avg(x).over(Window.partitionBy("event_type"))})
    fit = rows.groupBy("event_type").agg(
        F.max_by("x", "day").alias("y"), F.coalesce(F.stddev_samp(F.col("x") - F.col("y")), F.lit(0.0)).alias("s"),
        F.regr_slope(F.col("x") - F.col("y"), F.col("y")).alias("slope"), F.regr_intercept(F.col("x") - F.col("y"), F.col("y")).alias("cut"),
        F.regr_slope(F.col("x") / F.col("y") - 1, F.col("y")).alias("bend"), F.regr_intercept(F.col("x") / F.col("y") - 1, F.col("y")).alias("r"),
        F.regr_slope(F.col("z") - 2 * F.col("x") + F.col("y"), F.col("c")).alias("pull"), F.max_by("c", "day").alias("off"),
    )
    none = F.lit(None).cast("double")
    law = lambda name, y, **given: F.struct(F.lit(name).alias("law"), y.alias("y"), F.lit(0.5).alias("dt"), *[given.get(p, none).alias(p) for p in "abrck"])
    laws = F.array(
        law("linear_ode", F.col("y"), a=F.col("slope"), b=F.col("cut")),
        law("logistic", F.col("y"), r=F.col("r"), k=-F.col("r") / F.col("bend")),
        law("damped_oscillator", F.col("off"), c=F.lit(0.2), k=-F.col("pull")),
    )
    found = rollouts.stepped(fit.select("event_type", "s", F.inline(laws)), ["event_type"], STEPS)
    return found.select("event_type", "law", "step", "t", *[F.round(c, 5).alias(c) for c in ("value", "low", "high", "confidence")], "paused")


LAWS_SQL = f"""
WITH RECURSIVE {_DAYS},
x AS (
  SELECT event_type, day, v / 1000 AS x, lag(v / 1000) OVER w AS y, lead(v / 1000) OVER w AS z, v / 1000 - avg(v / 1000) OVER (PARTITION BY event_type) AS c
  FROM days WINDOW w AS (PARTITION BY event_type ORDER BY day)),
f AS (
  SELECT event_type, arg_max(x, day) AS last, coalesce(stddev_samp(x - y), 0) AS s, regr_slope(x - y, y) AS slope, regr_intercept(x - y, y) AS cut,
    regr_slope(x / y - 1, y) AS bend, regr_intercept(x / y - 1, y) AS r, regr_slope(z - 2 * x + y, c) AS pull, arg_max(c, day) AS off FROM x GROUP BY 1),
l AS (
  SELECT event_type, 'linear_ode' AS law, last AS y0, s, slope AS p, cut AS q FROM f
  UNION ALL SELECT event_type, 'logistic', last, s, r, -r / bend FROM f
  UNION ALL SELECT event_type, 'damped_oscillator', off, s, 0.2, -pull FROM f),
w AS (
  SELECT event_type, law, p, q, 0 AS step, y0 AS y, 0.0::DOUBLE AS v, greatest(s, 0.01 * abs(y0)) AS s, false AS paused FROM l
  UNION ALL
  SELECT event_type, law, p, q, step, y, v, s, 1.96 * s / abs(y) > 5 AND abs(y) > 1e-9 FROM (
    SELECT event_type, law, p, q, step + 1 AS step, y2 AS y, v2 AS v, g * s + 0.01 * abs(y2) AS s FROM (
      SELECT *, CASE law WHEN 'linear_ode' THEN y + 0.5 * (p * y + q) WHEN 'logistic' THEN y + 0.5 * p * y * (1 - y / greatest(q, 1e-9)) ELSE y + 0.5 * v2 END AS y2,
        CASE law WHEN 'linear_ode' THEN abs(1 + 0.5 * p) WHEN 'logistic' THEN abs(1 + 0.5 * p * (1 - 2 * y / greatest(q, 1e-9))) ELSE 1.05 END AS g
      FROM (SELECT *, v + 0.5 * (-p * v - q * y) AS v2 FROM w WHERE step < {STEPS} AND NOT paused)))),
o AS (SELECT *, {forecasting.Z} * s AS h FROM w WHERE step > 0)
SELECT event_type, law, step::INT AS step, step * 0.5::DOUBLE AS t, round(y, 5) AS value, round(y - h, 5) AS low, round(y + h, 5) AS high,
  round(greatest(0.05, 1 / (1 + (step - 1) * 0.05)), 5)::DOUBLE AS confidence, paused FROM o"""


def shared_periods(spark: SparkSession, d: str) -> DataFrame:
    """The period (in hours) that each pair of kinds of events shares most, by their hourly counts."""
    e = table(spark, d, "events")
    span = e.agg(F.min(F.unix_timestamp(F.date_trunc("hour", "ts"))).alias("a"), F.max(F.unix_timestamp("ts")).alias("z"))
    grid = e.select("event_type").distinct().join(F.broadcast(span)).select("event_type", "a", F.explode(F.sequence(F.lit(0), F.floor((F.col("z") - F.col("a")) / 3600))).alias("i"))
    counts = e.join(F.broadcast(span)).groupBy("event_type", F.floor((F.unix_timestamp("ts") - F.col("a")) / 3600).alias("i")).agg(F.count("*").alias("n"))
    rows = grid.join(counts, ["event_type", "i"], "left").select("event_type", "i", F.coalesce("n", F.lit(0)).alias("n"))
    return rollouts.shared_periods(rows, [], "event_type", "i", "n").select("a", "b", F.round("period", 6).alias("period"), F.round("coherence", 6).alias("coherence"))


PERIODS_SQL = """
WITH s AS (SELECT min(date_trunc('hour', ts)) AS a, max(ts) AS z FROM events),
g AS (SELECT event_type, unnest(range(0, floor((epoch(z) - epoch(a)) / 3600)::BIGINT + 1)) AS i FROM (SELECT DISTINCT event_type FROM events), s),
c AS (SELECT event_type, floor((floor(epoch(ts)) - epoch(a)) / 3600)::BIGINT AS i, count(*) AS n FROM events, s GROUP BY 1, 2),
r AS (SELECT event_type AS name, i, coalesce(n, 0)::DOUBLE AS x FROM g LEFT JOIN c USING (event_type, i)),
k AS (SELECT name, x, w, i - w * 32 AS j FROM (SELECT *, unnest([i // 32, i // 32 - 1]) AS w FROM r) WHERE w >= 0),
t AS (
  SELECT name, w, j, (x - avg(x) OVER v) * (0.5 - 0.5 * cos(2 * pi() * j / 63)) AS x FROM k
  WINDOW v AS (PARTITION BY name, w) QUALIFY count(*) OVER v = 64),
l AS (SELECT name, w, f, sum(x * cos(2 * pi() * f * j / 64)) AS re, sum(x * sin(2 * pi() * f * j / 64)) AS im FROM t, (SELECT unnest(range(1, 33)) AS f) GROUP BY 1, 2, 3),
m AS (
  SELECT a.name AS a, b.name AS b, f, count(*) AS n, sum(a.re * b.re + a.im * b.im) AS re, sum(a.im * b.re - a.re * b.im) AS im,
    sum(a.re * a.re + a.im * a.im) * sum(b.re * b.re + b.im * b.im) AS q
  FROM l a JOIN l b USING (w, f) WHERE a.name < b.name GROUP BY 1, 2, 3),
h AS (SELECT a, b, f, CASE WHEN q > 1e-14 THEN (re * re + im * im) / q ELSE 0 END AS coherence FROM m WHERE n >= 2)
SELECT a, b, round(64 / f, 6) AS period, round(coherence, 6) AS coherence FROM h
QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY round(coherence, 9) DESC, f) = 1"""

QUERIES = {
    "rollout_models": (rollout_models, MODELS_SQL),
    "rollout_bands": (rollout_bands, BANDS_SQL),
    "laws_stepped": (laws_stepped, LAWS_SQL),
    "shared_periods": (shared_periods, PERIODS_SQL),
}
