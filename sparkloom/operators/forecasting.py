"""Forecasts and backtests of ordered series, as windows and one regression a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import normal_quantile
from sparkloom.operators.preflight import numbered

Z = normal_quantile(0.975)


def placed(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys, i (from 1), n and x of the filled rows of each series."""
    g = Window.partitionBy(*keys)
    rows = df.where(F.col(value).isNotNull())
    return rows.select(*keys, F.row_number().over(g.orderBy(*order)).alias("i"), F.count("*").over(g).alias("n"), F.col(value).cast("double").alias("x"))


def _bands(told: DataFrame, keys: list[str], horizon: int, method: str, value: Column, sd: Column) -> DataFrame:
    steps = told.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.select(*keys, F.lit(method).alias("method"), "h", value.alias("value"), (value - Z * sd).alias("low"), (value + Z * sd).alias("high"))


def flat(rows: DataFrame, keys: list[str], horizon: int, last: int = 30) -> DataFrame:
    """The mean of the last rows with the band of their sample deviation."""
    told = rows.where(F.col("i") > F.col("n") - last).groupBy(*keys).agg(F.avg("x").alias("m"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("s"))
    return _bands(told, keys, horizon, "flat", F.col("m"), F.col("s"))


def ar1(rows: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """x(t + h) = mean + phi^h (x(t) - mean), the variance of the steps summed up; phi is held within 0.999."""
    before = rows.withColumn("b", F.lag("x").over(Window.partitionBy(*keys).orderBy("i")))
    told = before.groupBy(*keys).agg(F.avg("x").alias("m"), F.covar_pop("x", "b").alias("moved"), F.var_pop("b").alias("spread"), F.max_by("x", "i").alias("last"))
    told = told.withColumn("phi", F.greatest(F.lit(-0.999), F.least(F.lit(0.999), F.coalesce(F.when(F.col("spread") > 0, F.col("moved") / F.col("spread")), F.lit(0.0)))))
    rest = before.join(told, keys).where("b IS NOT NULL").groupBy(*keys).agg(F.coalesce(F.stddev_pop(F.col("x") - F.col("m") - F.col("phi") * (F.col("b") - F.col("m"))), F.lit(0.0)).alias("s"))
    square = F.col("phi") ** 2
    sd = F.col("s") * F.sqrt((1 - square ** F.col("h")) / (1 - square))
    return _bands(told.join(rest, keys), keys, horizon, "ar1", F.col("m") + F.col("phi") ** F.col("h") * (F.col("last") - F.col("m")), sd)


def seasonal(rows: DataFrame, keys: list[str], horizon: int, period: int = 7) -> DataFrame:
    """The value one period ago, with the deviation of changes over a period."""
    w = Window.partitionBy(*keys).orderBy("i")
    told = rows.withColumn("c", F.col("x") - F.lag("x", period).over(w)).groupBy(*keys).agg(F.coalesce(F.stddev_samp("c"), F.lit(0.0)).alias("s"))
    ends = rows.where(F.col("i") > F.col("n") - period).select(*keys, (F.col("i") - F.col("n") + period).alias("p"), "x")
    steps = told.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("p", (F.col("h") - 1) % period + 1)
    sd = F.col("s") * F.sqrt(F.floor((F.col("h") - 1) / period) + 1)
    return steps.join(ends, [*keys, "p"]).select(*keys, F.lit("seasonal").alias("method"), "h", F.col("x").alias("value"), (F.col("x") - Z * sd).alias("low"), (F.col("x") + Z * sd).alias("high"))


METHODS = {"flat": flat, "ar1": ar1, "seasonal": seasonal}


def chosen(df: DataFrame, keys: list[str], order: list[str], value: str, horizon: int) -> DataFrame:
    """The forecast of the method that did best on the last `horizon` rows, with its error there."""
    rows = placed(df, keys, order, value).cache()
    known = rows.where(F.col("i") <= F.col("n") - horizon).withColumn("n", F.col("n") - horizon)
    held = rows.where(F.col("i") > F.col("n") - horizon).select(*keys, (F.col("i") - F.col("n") + horizon).alias("h"), "x")
    tried = None
    for method in METHODS.values():
        one = method(known, keys, horizon)
        tried = one if tried is None else tried.unionByName(one)
    errors = tried.join(held, [*keys, "h"]).groupBy(*keys, "method").agg(F.sqrt(F.avg((F.col("x") - F.col("value")) ** 2)).alias("rmse"))
    best = errors.groupBy(*keys).agg(F.min(F.struct(F.round("rmse", 6).alias("rmse"), "method")).alias("b")).select(*keys, "b.*")
    told = None
    for method in METHODS.values():
        one = method(rows, keys, horizon)
        told = one if told is None else told.unionByName(one)
    return told.join(best, [*keys, "method"])


def backtest(df: DataFrame, keys: list[str], order: list[str], price: str, signal: Column, cost: float = 0.001) -> DataFrame:
    """Of each series, positions of the bar before earning this bar's return, less costs of changes: final equity, deepest drawdown (equity less its highest), trades and Sharpe ratio (population deviation)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumns({"_p": signal, "_r": F.coalesce(F.col(price) / F.lag(price).over(w) - 1, F.lit(0.0))})
    rows = rows.withColumn("_held", F.coalesce(F.lag("_p").over(w), F.lit(0)))
    rows = rows.withColumns({"_net": F.col("_held") * F.col("_r") - cost * F.abs(F.col("_held") - F.coalesce(F.lag("_held").over(w), F.lit(0))), "_trade": ((F.col("_held") != 0) & (F.col("_held") != F.coalesce(F.lag("_held").over(w), F.lit(0)))).cast("int")})
    rows = rows.withColumn("_equity", F.exp(F.sum(F.log1p("_net")).over(w)))
    rows = rows.withColumn("_down", F.col("_equity") - F.max("_equity").over(w))
    return rows.groupBy(*keys).agg(F.max_by("_equity", F.struct(*order)).alias("equity"), F.min("_down").alias("drawdown"), F.sum("_trade").alias("trades"), (F.avg("_net") / F.stddev_pop("_net")).alias("sharpe"))


def two_sided(df: DataFrame, keys: list[str], order: list[str], value: Column, enter: float, leave: float) -> DataFrame:
    """position: 1 from a value above `enter`, -1 from one below -`enter`, until it lies within `leave`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    told = F.when(value > enter, 1).when(value < -enter, -1).when(F.abs(value) < leave, 0)
    return df.withColumn("position", F.coalesce(F.last(told, ignorenulls=True).over(w), F.lit(0)))


def lag_relations(wide: DataFrame, order: str, names: list[str], most: int = 5) -> DataFrame:
    """a, b, lag, r of the strongest lag of each ordered pair of columns, and its strength. Rows are numbered by ranges and meet their shifted copies by number: no task holds them all."""
    rows = numbered(wide, [order]).select("pos", *names)
    lags = F.explode(F.sequence(F.lit(-most), F.lit(most)))
    shifted = rows.withColumn("lag", lags).select((F.col("pos") + F.col("lag")).alias("pos"), "lag", *[F.col(b).alias(f"_{b}") for b in names])
    parts = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, f"_{b}").alias("r")) for a in names for b in names if a != b]
    long = rows.join(shifted, "pos").groupBy("lag").agg(F.array(*parts).alias("p")).select("lag", F.inline("p"))
    best = long.groupBy("a", "b").agg(F.max_by(F.struct("lag", "r"), F.struct(F.round(F.abs("r"), 9), -F.abs("lag"), -F.col("lag"))).alias("m")).select("a", "b", "m.lag", "m.r")
    size = F.abs("r")
    return best.withColumn("strength", F.when(size >= 0.7, "strong").when(size >= 0.4, "medium").when(size >= 0.2, "weak").otherwise("none"))


def shape(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Of each series: trapezoid integral, turns (sign changes of the slope), longest rise or fall, mean curvature, bends (sign changes of the curvature) and a label."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = F.col(value)
    rows = df.withColumns({"_i": F.row_number().over(w), "_b": F.lag(value).over(w), "_a": F.lead(value).over(w)})
    rows = rows.withColumns({"_step": x - F.col("_b"), "_d2": F.col("_a") - 2 * x + F.col("_b")})
    rows = rows.withColumns({"_s": F.signum("_step"), "_c": F.signum("_d2")})
    rows = rows.withColumns({"_turn": (F.col("_s") * F.lag("_s").over(w) < 0).cast("int"), "_bend": (F.col("_c") * F.lag("_c").over(w) < 0).cast("int"), "_run": F.sum(F.when(F.col("_s") == F.lag("_s").over(w), 0).otherwise(1)).over(w)})
    longest = rows.where("_step IS NOT NULL").groupBy(*keys, "_run").agg(F.count("*").alias("k")).groupBy(*keys).agg(F.max("k").alias("longest_run"))
    told = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum((x + F.col("_b")) / 2), F.lit(0.0)).alias("integral"), F.coalesce(F.sum("_turn"), F.lit(0)).alias("turns"), F.coalesce(F.sum("_bend"), F.lit(0)).alias("bends"), F.avg(F.abs("_d2")).alias("curvature"), F.corr("_i", value).alias("trend"))
    label = F.when(F.col("turns") == 0, F.when(F.col("trend") > 0, "rising").otherwise("falling")).when(F.col("turns") > 0.5 * F.col("n"), "oscillating").when(F.abs("trend") > 0.7, "trending").otherwise("mixed")
    return told.withColumn("label", label).join(longest, keys).drop("trend")


def diagnostics(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """n, phi (AR(1) with Kendall's correction), skewness and excess kurtosis (unbiased) of each series."""
    rows = placed(df, keys, order, value)
    before = rows.withColumn("b", F.lag("x").over(Window.partitionBy(*keys).orderBy("i")))
    told = before.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("x", "b").alias("r"), F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2"))
    n = F.col("n")
    return told.select(*keys, "n", (F.col("r") + (1 + 3 * F.col("r")) / n).alias("phi"), (F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"), (((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3))).alias("kurtosis"))


def periodogram(df: DataFrame, keys: list[str], seconds: Column, value: str, frequencies: list[float]) -> DataFrame:
    """frequency and power (Lomb-Scargle, normalised) of unevenly spaced values: sums over all rows for each frequency."""
    mean = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_v"), F.count(value).alias("_n"))
    rows = df.join(F.broadcast(mean), keys).withColumns({"_t": seconds, "_y": F.col(value) - F.col("_m")})
    grid = rows.withColumn("frequency", F.explode(F.array(*map(F.lit, frequencies)))).withColumn("_w", 2 * F.pi() * F.col("frequency") * F.col("_t"))
    c, s, y = F.cos("_w"), F.sin("_w"), F.col("_y")
    sums = grid.groupBy(*keys, "frequency").agg(F.sum(y * c).alias("yc"), F.sum(y * s).alias("ys"), F.sum(c * c).alias("cc"), F.sum(s * s).alias("ss"), F.sum(c * s).alias("cs"), F.first("_v").alias("v"))
    # the delay tau makes cosines and sines orthogonal; written out with the sums above
    d = F.col("cc") * F.col("ss") - F.col("cs") ** 2
    power = (F.col("yc") ** 2 * F.col("ss") + F.col("ys") ** 2 * F.col("cc") - 2 * F.col("yc") * F.col("ys") * F.col("cs")) / d / (2 * F.col("v"))
    return sums.select(*keys, "frequency", power.alias("power"))


def representative(df: DataFrame, keys: list[str], order: list[str], value: str, most: int, limit: float = 4.0) -> DataFrame:
    """Rows kept for a kernel that can't take all: those beyond `limit` robust deviations, and evenly spaced ones."""
    rows = placed(df, keys, order, value)
    middle = rows.groupBy(*keys).agg(F.median("x").alias("m"))
    spread = rows.join(middle, keys).groupBy(*keys).agg(F.first("m").alias("m"), F.median(F.abs(F.col("x") - F.col("m"))).alias("mad"))
    step = F.greatest(F.lit(1), F.ceil(F.col("n") / most))
    return rows.join(spread, keys).where(((F.col("mad") > 0) & (F.abs(0.6745 * (F.col("x") - F.col("m")) / F.col("mad")) >= limit)) | ((F.col("i") - 1) % step == 0)).select(*keys, "i", "x")
