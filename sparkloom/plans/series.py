"""Queries on ordered series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators import series
from sparkloom.packaging import shipped
from sparkloom.sources import table


def _days(spark: SparkSession, d: str) -> DataFrame:
    return table(shipped(spark), d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("v"), F.count("*").cast("double").alias("n"))


_DAYS = "days AS (SELECT event_type, ts::DATE AS day, round(sum(value), 4) AS v, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2)"


def rolling(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy("day").rowsBetween(-6, 0)
    return _days(spark, d).select("event_type", F.col("day").cast("string").alias("day"), F.round(F.avg("v").over(w), 3).alias("mean"), F.round(F.stddev_pop("v").over(w), 3).alias("sd"))


def derivatives(spark: SparkSession, d: str) -> DataFrame:
    found = series.derivatives(_days(spark, d), ["event_type"], ["day"], "v")
    return found.select("event_type", F.col("day").cast("string").alias("day"), F.round("d1", 3).alias("d1"), F.round("d2", 3).alias("d2"))


def ar1(spark: SparkSession, d: str) -> DataFrame:
    return series.ar1(_days(spark, d), ["event_type"], ["day"], "v").select("event_type", "n", F.round("phi", 6).alias("phi"))


def cross_correlation(spark: SparkSession, d: str) -> DataFrame:
    return series.cross_correlation(_days(spark, d), ["event_type"], ["day"], "v", "n", 3).select("event_type", "lag", F.round("r", 6).alias("r"))


CROSS_SQL = f"WITH {_DAYS}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM days) SELECT a.event_type, (b.i - a.i)::INT AS lag, round(corr(a.v, b.n), 6) AS r FROM r a JOIN r b ON a.event_type = b.event_type AND abs(b.i - a.i) <= 3 GROUP BY 1, 2"


def drawdown(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy("day")
    days = _days(spark, d).withColumn("ret", F.coalesce(F.col("v") / F.lag("v").over(w) - 1, F.lit(0.0)))
    return series.drawdowns(days, ["event_type"], ["day"], "ret").groupBy("event_type").agg(F.round(F.min("drawdown"), 6).alias("deepest"), F.round(F.max("equity"), 6).alias("highest"))


DRAWDOWN_SQL = f"WITH {_DAYS}, r AS (SELECT *, coalesce(v / lag(v) OVER w - 1, 0) AS ret FROM days WINDOW w AS (PARTITION BY event_type ORDER BY day)), e AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY event_type ORDER BY day)) AS e FROM r), m AS (SELECT *, e - max(e) OVER (PARTITION BY event_type ORDER BY day) AS dd FROM e) SELECT event_type, round(min(dd), 6) AS deepest, round(max(e), 6) AS highest FROM m GROUP BY 1"


def hysteresis(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    found = series.hysteresis(e, ["user_id"], ["ts", "event_id"], "value", 300.0, 50.0)
    return found.groupBy("user_id").agg(F.sum("position").alias("held"), F.count("*").alias("n"))


HYSTERESIS_SQL = "WITH s AS (SELECT user_id, ts, event_id, CASE WHEN value > 300 THEN 1 WHEN value < 50 THEN 0 END AS told FROM events), p AS (SELECT user_id, coalesce(last_value(told IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS position FROM s) SELECT user_id, sum(position)::BIGINT AS held, count(*) AS n FROM p GROUP BY 1"


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Segments of a user's events, cut where a day passes without one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("gap", F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)))
    cut = series.segments(e, ["user_id"], ["ts", "event_id"], F.col("gap") > 86_400_000_000)
    return cut.groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


SESSION_SQL = "WITH g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events), s AS (SELECT *, sum((coalesce(gap, 0) > 86400000000)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS segment FROM g) SELECT user_id, segment, count(*) AS n, round(avg(value), 4) AS mean FROM s GROUP BY 1, 2"


def residual_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Log changes of daily values further than two deviations from their mean."""
    w, g = Window.partitionBy("event_type").orderBy("day"), Window.partitionBy("event_type")
    r = _days(spark, d).withColumn("x", F.log(F.col("v") / F.lag("v").over(w))).where("x IS NOT NULL")
    z = r.withColumn("z", (F.col("x") - F.avg("x").over(g)) / F.stddev_pop("x").over(g))
    return z.where("abs(z) >= 2").select("event_type", F.col("day").cast("string").alias("day"), F.round("z", 5).alias("z"))


RESIDUAL_SQL = f"WITH {_DAYS}, r AS (SELECT *, ln(v / lag(v) OVER (PARTITION BY event_type ORDER BY day)) AS x FROM days), z AS (SELECT event_type, day, (x - avg(x) OVER g) / stddev_pop(x) OVER g AS z FROM r WHERE x IS NOT NULL WINDOW g AS (PARTITION BY event_type)) SELECT event_type, strftime(day, '%Y-%m-%d') AS day, round(z, 5) AS z FROM z WHERE abs(z) >= 2"


def cusum(spark: SparkSession, d: str) -> DataFrame:
    e = table(shipped(spark), d, "events").where("user_id IS NOT NULL")
    return series.cusum(e, ["user_id"], "user_id long", ["ts", "event_id"], "value", limit=4.0)


def matrix_profile(spark: SparkSession, d: str) -> DataFrame:
    found = series.matrix_profile(_days(spark, d), ["event_type"], "event_type string", ["day"], "v", 5)
    return found.withColumn("distance", F.round("distance", 6))


def spectral_entropy(spark: SparkSession, d: str) -> DataFrame:
    return series.spectral_entropy(_days(spark, d), ["event_type"], "event_type string", ["day"], "v").withColumn("entropy", F.round("entropy", 6))


def kalman(spark: SparkSession, d: str) -> DataFrame:
    return series.kalman(_days(spark, d), ["event_type"], "event_type string", ["day"], "v").select("event_type", "at", F.round("level", 4).alias("level"))


QUERIES = {
    "series_rolling": (rolling, f"WITH {_DAYS} SELECT event_type, strftime(day, '%Y-%m-%d') AS day, round(avg(v) OVER w, 3) AS mean, round(stddev_pop(v) OVER w, 3) AS sd FROM days WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"),
    "series_derivatives": (derivatives, f"WITH {_DAYS}, l AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a FROM days WINDOW w AS (PARTITION BY event_type ORDER BY day)) SELECT event_type, strftime(day, '%Y-%m-%d') AS day, round(CASE WHEN b IS NULL THEN a - v WHEN a IS NULL THEN v - b ELSE (a - b) / 2 END, 3) AS d1, round(a - 2 * v + b, 3) AS d2 FROM l"),
    "series_ar1": (ar1, f"WITH {_DAYS}, l AS (SELECT *, lag(v) OVER (PARTITION BY event_type ORDER BY day) AS b FROM days) SELECT event_type, count(*) AS n, round(covar_pop(v, b) / var_pop(b), 6) AS phi FROM l WHERE b IS NOT NULL GROUP BY 1"),
    "series_cross_correlation": (cross_correlation, CROSS_SQL),
    "series_drawdown": (drawdown, DRAWDOWN_SQL),
    "series_hysteresis": (hysteresis, HYSTERESIS_SQL),
    "series_sessions": (sessions, SESSION_SQL),
    "series_residual_anomalies": (residual_anomalies, RESIDUAL_SQL),
    "series_cusum": (cusum, None),
    "series_matrix_profile": (matrix_profile, None),
    "series_spectral_entropy": (spectral_entropy, None),
    "series_kalman": (kalman, None),
}
