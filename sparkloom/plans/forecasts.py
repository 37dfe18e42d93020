"""Queries on forecasts, backtests and relations of series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators import forecasting
from sparkloom.plans.series import _DAYS, _days
from sparkloom.sources import table

Z = forecasting.Z
H = 7


def forecast_methods(spark: SparkSession, d: str) -> DataFrame:
    """A week of each kind's daily value by each method, with 95 % bands."""
    rows = forecasting.placed(_days(spark, d), ["event_type"], ["day"], "v")
    found = None
    for method in forecasting.METHODS.values():
        one = method(rows, ["event_type"], H)
        found = one if found is None else found.unionByName(one)
    return found.select("event_type", "method", "h", *[F.round(c, 3).alias(c) for c in ("value", "low", "high")])


def _methods_sql(source: str, out: str) -> str:
    return f"""r{out} AS ({source}),
fl{out} AS (SELECT event_type, 'flat' AS method, h, m AS value, s AS sd FROM (SELECT event_type, avg(x) AS m, coalesce(stddev_samp(x), 0) AS s FROM r{out} WHERE i > n - 30 GROUP BY 1), (SELECT unnest(range(1, {H + 1})) AS h)),
b{out} AS (SELECT *, lag(x) OVER (PARTITION BY event_type ORDER BY i) AS b FROM r{out}),
p{out} AS (SELECT event_type, avg(x) AS m, greatest(-0.999, least(0.999, coalesce(covar_pop(x, b) / var_pop(b), 0))) AS phi, arg_max(x, i) AS l FROM b{out} GROUP BY 1),
s{out} AS (SELECT event_type, stddev_pop(x - m - phi * (b - m)) AS s FROM b{out} JOIN p{out} USING (event_type) WHERE b IS NOT NULL GROUP BY 1),
ar{out} AS (SELECT event_type, 'ar1' AS method, h, m + phi ** h * (l - m) AS value, s * sqrt((1 - phi ** (2 * h)) / (1 - phi ** 2)) AS sd FROM p{out} JOIN s{out} USING (event_type), (SELECT unnest(range(1, {H + 1})) AS h)),
c{out} AS (SELECT event_type, stddev_samp(c) AS s FROM (SELECT event_type, x - lag(x, 7) OVER (PARTITION BY event_type ORDER BY i) AS c FROM r{out}) GROUP BY 1),
se{out} AS (SELECT event_type, 'seasonal' AS method, (i - n + 7) AS h, x AS value, s AS sd FROM r{out} JOIN c{out} USING (event_type) WHERE i > n - 7),
f{out} AS (SELECT * FROM fl{out} UNION ALL SELECT * FROM ar{out} UNION ALL SELECT * FROM se{out})"""


_ROWS = "SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, count(*) OVER (PARTITION BY event_type) AS n, v AS x FROM days"
_HELD = f"SELECT event_type, i, n - {H} AS n, x FROM ra WHERE i <= n - {H}"
METHODS_SQL = f"WITH {_DAYS}, {_methods_sql(_ROWS, 'a')} SELECT event_type, method, h::INT AS h, round(value, 3) AS value, round(value - {Z} * sd, 3) AS low, round(value + {Z} * sd, 3) AS high FROM fa"


def forecast_chosen(spark: SparkSession, d: str) -> DataFrame:
    found = forecasting.chosen(_days(spark, d), ["event_type"], ["day"], "v", H)
    return found.select("event_type", "method", "h", F.round("value", 3).alias("value"), F.round("rmse", 3).alias("rmse"))


CHOSEN_SQL = f"""WITH {_DAYS}, {_methods_sql(_ROWS, "a")}, {_methods_sql(_HELD, "k")}, held AS (SELECT event_type, i - n + {H} AS h, x FROM ra WHERE i > n - {H}),
e AS (SELECT event_type, method, sqrt(avg((x - value) ** 2)) AS rmse FROM fk JOIN held USING (event_type, h) GROUP BY 1, 2), best AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY round(rmse, 6), method) = 1)
SELECT event_type, method, h::INT AS h, round(value, 3) AS value, round(rmse, 3) AS rmse FROM fa JOIN best USING (event_type, method)"""


def backtest_crossing(spark: SparkSession, d: str) -> DataFrame:
    """Long above the mean of the week, out below it, from the next day on."""
    w = Window.partitionBy("event_type").orderBy("day").rowsBetween(-6, 0)
    days = _days(spark, d).withColumn("m", F.avg("v").over(w))
    found = forecasting.backtest(days, ["event_type"], ["day"], "v", F.when(F.col("v") > F.col("m"), 1).otherwise(0))
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in ("equity", "drawdown", "sharpe")], "trades")


BACKTEST_SQL = f"""WITH {_DAYS}, s AS (SELECT event_type, day, CASE WHEN v > avg(v) OVER (PARTITION BY event_type ORDER BY day ROWS 6 PRECEDING) THEN 1 ELSE 0 END AS p, coalesce(v / lag(v) OVER (PARTITION BY event_type ORDER BY day) - 1, 0) AS r FROM days),
h AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY event_type ORDER BY day), 0) AS h FROM s), n AS (SELECT *, coalesce(lag(h) OVER (PARTITION BY event_type ORDER BY day), 0) AS b FROM h),
e AS (SELECT *, h * r - 0.001 * abs(h - b) AS net, (h <> 0 AND h <> b)::INT AS t FROM n), q AS (SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY event_type ORDER BY day)) AS eq FROM e), w AS (SELECT *, eq - max(eq) OVER (PARTITION BY event_type ORDER BY day) AS dd FROM q)
SELECT event_type, round(arg_max(eq, day), 6) AS equity, round(min(dd), 6) AS drawdown, round(avg(net) / stddev_pop(net), 6) AS sharpe, sum(t)::BIGINT AS trades FROM w GROUP BY 1"""


def hysteresis_two_sided(spark: SparkSession, d: str) -> DataFrame:
    g = Window.partitionBy("user_id")
    e = table(spark, d, "events").withColumn("z", (F.col("value") - F.avg("value").over(g)) / F.stddev_pop("value").over(g))
    found = forecasting.two_sided(e, ["user_id"], ["ts", "event_id"], F.col("z"), 1.0, 0.3)
    return found.groupBy("user_id", "position").agg(F.count("*").alias("n"))


TWO_SIDED_SQL = """WITH z AS (SELECT user_id, ts, event_id, (value - avg(value) OVER (PARTITION BY user_id)) / stddev_pop(value) OVER (PARTITION BY user_id) AS z FROM events),
t AS (SELECT *, CASE WHEN z > 1 THEN 1 WHEN z < -1 THEN -1 WHEN abs(z) < 0.3 THEN 0 END AS t FROM z), p AS (SELECT user_id, coalesce(last_value(t IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS position FROM t)
SELECT user_id, position, count(*) AS n FROM p GROUP BY 1, 2"""


def lag_relations(spark: SparkSession, d: str) -> DataFrame:
    """The strongest lag between each ordered pair of kinds of events."""
    days = _days(spark, d)
    kinds = [r[0] for r in days.select("event_type").distinct().orderBy("event_type").collect()]
    wide = days.groupBy("day").pivot("event_type", kinds).agg(F.first("v"))
    return forecasting.lag_relations(wide, "day", kinds).select("a", "b", "lag", F.round("r", 6).alias("r"), "strength")


LAGS_SQL = f"""WITH {_DAYS}, g AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT DISTINCT day FROM days)), s AS (SELECT event_type, i, v FROM days JOIN g USING (day)),
r AS (SELECT x.event_type AS a, y.event_type AS b, x.i - y.i AS lag, corr(x.v, y.v) AS r FROM s x JOIN s y ON x.event_type <> y.event_type AND abs(x.i - y.i) <= 5 GROUP BY 1, 2, 3),
k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY round(abs(r), 9) DESC, abs(lag), lag) = 1)
SELECT a, b, lag::INT AS lag, round(r, 6) AS r, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'medium' WHEN abs(r) >= 0.2 THEN 'weak' ELSE 'none' END AS strength FROM k"""


def series_shape(spark: SparkSession, d: str) -> DataFrame:
    return forecasting.shape(_days(spark, d), ["event_type"], ["day"], "v").select("event_type", "n", F.round("integral", 3).alias("integral"), "turns", "bends", F.round("curvature", 4).alias("curvature"), "label", "longest_run")


SHAPE_SQL = f"""WITH {_DAYS}, a AS (SELECT event_type, day, v, row_number() OVER w AS i, lag(v) OVER w AS b, lead(v) OVER w AS f FROM days WINDOW w AS (PARTITION BY event_type ORDER BY day)), s AS (SELECT *, v - b AS st, f - 2 * v + b AS d2, sign(v - b) AS s, sign(f - 2 * v + b) AS c FROM a),
t AS (SELECT *, (s * lag(s) OVER w < 0)::INT AS turn, (c * lag(c) OVER w < 0)::INT AS bend, CASE WHEN s = lag(s) OVER w THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY event_type ORDER BY day)), u AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY day) AS run FROM t),
l AS (SELECT event_type, max(k) AS longest_run FROM (SELECT event_type, run, count(*) AS k FROM u WHERE st IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT event_type, count(*) AS n, sum((v + b) / 2) AS integral, sum(turn)::BIGINT AS turns, coalesce(sum(bend), 0)::BIGINT AS bends, avg(abs(d2)) AS curvature, corr(i, v) AS trend FROM u GROUP BY 1)
SELECT event_type, n, round(integral, 3) AS integral, turns, bends, round(curvature, 4) AS curvature, CASE WHEN turns = 0 THEN CASE WHEN trend > 0 THEN 'rising' ELSE 'falling' END WHEN turns > 0.5 * n THEN 'oscillating' WHEN abs(trend) > 0.7 THEN 'trending' ELSE 'mixed' END AS label, longest_run FROM m JOIN l USING (event_type)"""


def series_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return forecasting.diagnostics(e, ["user_id"], ["ts", "event_id"], "value").select("user_id", "n", *[F.round(c, 5).alias(c) for c in ("phi", "skewness", "kurtosis")])


DIAGNOSTICS_SQL = """WITH b AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), r AS (SELECT user_id, count(*) AS n, corr(value, b) AS r, skewness(value) AS s, kurtosis(value) AS k FROM b GROUP BY 1)
SELECT user_id, n, round(r + (1 + 3 * r) / n, 5) AS phi, round(s, 5) AS skewness, round(k, 5) AS kurtosis FROM r"""


def uneven_periodogram(spark: SparkSession, d: str) -> DataFrame:
    """Power of events' values at ten frequencies, from their uneven times."""
    e = table(spark, d, "events")
    found = forecasting.periodogram(e, ["event_type"], F.unix_micros("ts") / 8.64e10 - 19723, "value", [round(0.1 * k, 1) for k in range(1, 11)])
    return found.select("event_type", "frequency", F.round("power", 4).alias("power"))


PERIODOGRAM_SQL = """WITH m AS (SELECT event_type, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1), r AS (SELECT event_type, f, v, value - m AS y, 2 * pi() * f * (epoch_us(ts) / 8.64e10::DOUBLE - 19723) AS w FROM events JOIN m USING (event_type), (SELECT round(unnest(range(1, 11)) * 0.1::DOUBLE, 1) AS f)),
s AS (SELECT event_type, f, any_value(v) AS v, sum(y * cos(w)) AS yc, sum(y * sin(w)) AS ys, sum(cos(w) ** 2) AS cc, sum(sin(w) ** 2) AS ss, sum(cos(w) * sin(w)) AS cs FROM r GROUP BY 1, 2)
SELECT event_type, f AS frequency, round((yc ** 2 * ss + ys ** 2 * cc - 2 * yc * ys * cs) / (cc * ss - cs ** 2) / (2 * v), 4) AS power FROM s"""


def representative_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return forecasting.representative(e, ["event_type"], ["ts", "event_id"], "value", 100).select("event_type", "i", F.round("x", 4).alias("x"))


REPRESENTATIVE_SQL = """WITH r AS (SELECT event_type, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), m AS (SELECT event_type, median(x) AS m FROM r GROUP BY 1), s AS (SELECT event_type, any_value(m) AS m, median(abs(x - m)) AS mad FROM r JOIN m USING (event_type) GROUP BY 1)
SELECT event_type, i, round(x, 4) AS x FROM r JOIN s USING (event_type) WHERE (mad > 0 AND abs(0.6745 * (x - m) / mad) >= 4) OR (i - 1) % greatest(1, ceil(n / 100)) = 0"""


def weighted_anomaly(spark: SparkSession, d: str) -> DataFrame:
    """Rows furthest from the mean over several columns at once, each weighed: the root of the summed squares of weighted deviations."""
    l = table(spark, d, "lineitem")
    weights = {"l_quantity": 0.5, "l_extendedprice": 0.3, "l_discount": 0.2}
    got = l.agg(*[F.avg(c).alias(f"m_{c}") for c in weights], *[F.stddev_samp(c).alias(f"s_{c}") for c in weights]).first()
    score = F.sqrt(sum((w * (F.col(c) - got[f"m_{c}"]) / got[f"s_{c}"]) ** 2 for c, w in weights.items()))
    return l.select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "l_orderkey", "l_linenumber").limit(20)


ANOMALY_SQL = """WITH g AS (SELECT avg(l_quantity) AS a, stddev_samp(l_quantity) AS sa, avg(l_extendedprice) AS b, stddev_samp(l_extendedprice) AS sb, avg(l_discount) AS c, stddev_samp(l_discount) AS sc FROM lineitem)
SELECT l_orderkey, l_linenumber, round(sqrt((0.5 * (l_quantity - a) / sa) ** 2 + (0.3 * (l_extendedprice - b) / sb) ** 2 + (0.2 * (l_discount - c) / sc) ** 2), 6) AS score FROM lineitem, g ORDER BY score DESC, l_orderkey, l_linenumber LIMIT 20"""


def z_mean_lags(spark: SparkSession, d: str) -> DataFrame:
    """Mean product of two z-normalised series at lags up to five."""
    g, w = Window.partitionBy("event_type"), Window.partitionBy("event_type").orderBy("day")
    z = _days(spark, d).withColumns({"a": (F.col("v") - F.avg("v").over(g)) / F.stddev_pop("v").over(g), "b": (F.col("n") - F.avg("n").over(g)) / F.stddev_pop("n").over(g)})
    z = z.withColumns({f"b{k + 5}": F.lead("b", k).over(w) if k >= 0 else F.lag("b", -k).over(w) for k in range(-5, 6)})
    return z.groupBy("event_type").agg(F.array(*[F.struct(F.lit(k).alias("lag"), F.round(F.avg(F.col("a") * F.col(f"b{k + 5}")), 6).alias("r")) for k in range(-5, 6)]).alias("p")).select("event_type", F.inline("p"))


Z_LAGS_SQL = f"WITH {_DAYS}, z AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, (v - avg(v) OVER g) / stddev_pop(v) OVER g AS a, (n - avg(n) OVER g) / stddev_pop(n) OVER g AS b FROM days WINDOW g AS (PARTITION BY event_type)) SELECT x.event_type, (y.i - x.i)::INT AS lag, round(avg(x.a * y.b), 6) AS r FROM z x JOIN z y ON x.event_type = y.event_type AND abs(x.i - y.i) <= 5 GROUP BY 1, 2"


def split_rmse(spark: SparkSession, d: str) -> DataFrame:
    """A time split: the training mean's error on later days, at shocks of 0.8, 1 and 1.2 to what was forecast."""
    days = _days(spark, d).withColumn("train", F.col("day") < F.lit("2024-01-22").cast("date"))
    g = Window.partitionBy("event_type")
    told = days.withColumn("m", F.avg(F.when(F.col("train"), F.col("v"))).over(g)).where("NOT train")
    shocks = told.withColumn("shock", F.explode(F.array(*map(F.lit, (0.8, 1.0, 1.2)))))
    return shocks.groupBy("event_type", "shock").agg(F.round(F.sqrt(F.avg((F.col("v") - F.col("m") * F.col("shock")) ** 2)), 4).alias("rmse"))


SPLIT_SQL = f"WITH {_DAYS}, t AS (SELECT event_type, avg(v) AS m FROM days WHERE day < DATE '2024-01-22' GROUP BY 1) SELECT event_type, s.shock, round(sqrt(avg((v - m * s.shock) ** 2)), 4) AS rmse FROM days JOIN t USING (event_type), (VALUES (0.8::DOUBLE), (1.0), (1.2)) s(shock) WHERE day >= DATE '2024-01-22' GROUP BY 1, 2"

QUERIES = {
    "forecast_methods": (forecast_methods, METHODS_SQL),
    "forecast_chosen": (forecast_chosen, CHOSEN_SQL),
    "backtest_crossing": (backtest_crossing, BACKTEST_SQL),
    "hysteresis_two_sided": (hysteresis_two_sided, TWO_SIDED_SQL),
    "lag_relations": (lag_relations, LAGS_SQL),
    "series_shape": (series_shape, SHAPE_SQL),
    "series_diagnostics": (series_diagnostics, DIAGNOSTICS_SQL),
    "uneven_periodogram": (uneven_periodogram, PERIODOGRAM_SQL),
    "representative_rows": (representative_rows, REPRESENTATIVE_SQL),
    "weighted_anomaly": (weighted_anomaly, ANOMALY_SQL),
    "z_mean_lags": (z_mean_lags, Z_LAGS_SQL),
    "split_rmse": (split_rmse, SPLIT_SQL),
}
