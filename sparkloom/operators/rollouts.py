"""Series carried forward: the better of a random walk and an AR(1) with simulated bands, three laws stepped
from the last value, and periods that two series share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators.estimates import _uniform as uniform
from sparkloom.operators.forecasting import Z, placed

#: Growth of an oscillator's deviation a step, share of the value added to every deviation.
GROWTH, SHARE = 1.05, 0.01
LAWS = ("linear_ode", "logistic", "damped_oscillator")


def _fits(rows: DataFrame, keys: list[str]) -> DataFrame:
    """last, s_walk (deviation of the steps), phi (through the origin, within 0.99; 0.9 under 20 rows) and s_ar1 of each series; a deviation of 0 counts as 1."""
    before = rows.withColumn("b", F.lag("x").over(Window.partitionBy(*keys).orderBy("i"))).withColumn("step", F.col("x") - F.col("b"))
    square = F.sum("b_square")
    told = before.withColumns({"b_square": F.col("b") * F.col("b"), "product": F.col("b") * F.col("x")}).groupBy(*keys).agg(
        F.count("*").alias("n_fit"), F.max_by("x", "i").alias("last"), F.stddev_samp("step").alias("s_walk"),
        F.when(square > 1e-9, F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.sum("product") / square))).alias("raw"),
    )
    enough = F.col("n_fit") >= 20
    told = told.withColumn("phi", F.when(enough, F.coalesce("raw", F.lit(0.9))).otherwise(0.9))
    rest = before.join(told.select(*keys, "phi"), keys).groupBy(*keys).agg(F.stddev_pop(F.col("x") - F.col("phi") * F.col("b")).alias("s_ar1"))
    unit = lambda c: F.when(F.col(c) > 1e-9, F.col(c)).otherwise(1.0)
    return told.join(rest, keys).select(*keys, "last", "phi", F.when(F.col("n_fit") >= 3, unit("s_walk")).otherwise(1.0).alias("s_walk"), F.when(enough, unit("s_ar1")).otherwise(1.0).alias("s_ar1"))


def model_scores(rows: DataFrame, keys: list[str], holdout: int) -> DataFrame:
    """keys, model, rmse and score (the error over the deviation, below zero) of both models' mean paths over the last `holdout` rows; over all rows where no more than `holdout` + 10 are there."""
    held = F.col("n") > holdout + 10
    # a series too short for a holdout is scored on the rows it was fitted on, from its last value
    fit = _fits(rows.where(~held | (F.col("i") <= F.col("n") - holdout)), keys)
    tried = rows.where(~held | (F.col("i") > F.col("n") - holdout)).withColumn("h", F.when(held, F.col("i") - F.col("n") + holdout).otherwise(F.col("i")))
    both = tried.join(fit, keys).groupBy(*keys).agg(
        F.sqrt(F.avg((F.col("x") - F.col("last")) ** 2)).alias("random_walk"),
        F.sqrt(F.avg((F.col("x") - F.col("last") * F.col("phi") ** F.col("h")) ** 2)).alias("ar1"),
        F.stddev_pop("x").alias("sd"),
    )
    models = [F.struct(F.lit(m).alias("model"), F.col(m).alias("rmse")) for m in ("ar1", "random_walk")]
    return both.select(*keys, "sd", F.inline(F.array(*models))).select(*keys, "model", "rmse", (-F.col("rmse") / (F.col("sd") + 1e-9)).alias("score"))


def rollout(df: DataFrame, keys: list[str], order: list[str], value: str, horizon: int = 24, paths: int = 1000, holdout: int = 500, seed: int = 42) -> DataFrame:
    """keys, model (the better on the holdout; ties to ar1), h, p05, p50, p95, mean and sd of simulated paths of each series.

    The normal steps come from a hash of the seed, the keys, the path and the step, so a path is
    the same on any cluster and on a task that is run again. Paths are rows; none meets another but in the
    sums. Null values are left out; a series of one row has the deviation 1.
    """
    rows = placed(df, keys, order, value)
    best = model_scores(rows, keys, holdout).groupBy(*keys).agg(F.max_by("model", F.struct(F.round("score", 9), (F.col("model") == "ar1").cast("int"))).alias("model"))
    walks = F.col("model") == "random_walk"
    fit = _fits(rows, keys).join(best, keys).select(*keys, "model", "last", F.when(walks, 1.0).otherwise(F.col("phi")).alias("phi"), F.when(walks, F.col("s_walk")).otherwise(F.col("s_ar1")).alias("s"))
    paths_ = fit.withColumn("path", F.explode(F.sequence(F.lit(1), F.lit(paths))))
    noise = lambda h: F.sqrt(-2 * F.log1p(-uniform(seed, *map(F.col, keys), F.col("path"), h, "r"))) * F.cos(2 * math.pi * uniform(seed, *map(F.col, keys), F.col("path"), h, "a"))
    steps = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: F.col("s") * noise(h))
    # one fold makes a path: the state is the list of values so far
    walked = F.aggregate(steps, F.array(F.col("last")), lambda told, e: F.concat(told, F.array(F.element_at(told, -1) * F.col("phi") + e)))
    long = paths_.select(*keys, "model", F.posexplode(walked).alias("h", "x")).where("h > 0")
    shares = [F.percentile("x", p).alias(n) for p, n in ((0.05, "p05"), (0.5, "p50"), (0.95, "p95"))]
    return long.groupBy(*keys, "model", "h").agg(*shares, F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))


def stepped(laws: DataFrame, keys: list[str], steps: int = 50, limit: float = 5.0) -> DataFrame:
    """keys, law, step, t, value, low, high, confidence and paused of each law's Euler steps from its last value.

    laws: keys, law, y (the value to start from), s (its deviation; 0.01 |y| at least), dt and the
    parameters: a, b of linear_ode (y' = a y + b); r, k of logistic (y' = r y (1 - y / k)); c, k of damped_oscillator
    (y'' + c y' + k y = 0, from rest); unused ones null. Deviations grow by the law's derivative (an
    oscillator's by 5 %) and by 1 % of the value. A path ends with the first step whose band is wider than `limit` times
    the value; that step is paused. Other laws, and rows without y, have no path.
    """
    number = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0))
    dt = F.coalesce(F.col("dt").cast("double"), F.lit(1.0))
    a, b, r, c, k = map(number, ("a", "b", "r", "c", "k"))
    room = F.greatest(F.coalesce(F.col("k").cast("double"), F.lit(1.0)), F.lit(1e-9))
    law = F.col("law")

    def step(told: Column, i: Column) -> Column:
        y, v, s = told["y"], told["v"], told["s"]
        speed = v + dt * (-c * v - k * y)
        value = F.when(law == "linear_ode", y + dt * (a * y + b)).when(law == "logistic", y + dt * r * y * (1 - y / room)).otherwise(y + dt * speed)
        growth = F.when(law == "linear_ode", F.abs(1 + a * dt)).when(law == "logistic", F.abs(1 + dt * r * (1 - 2 * y / room))).otherwise(GROWTH)
        wide = growth * s + SHARE * F.abs(value)
        return F.struct(value.alias("y"), F.when(law == "damped_oscillator", speed).otherwise(0.0).alias("v"), wide.alias("s"))

    start = F.struct(F.col("y").cast("double").alias("y"), F.lit(0.0).alias("v"), F.greatest(number("s"), SHARE * F.abs(F.col("y").cast("double"))).alias("s"))
    # the fold keeps every state, so that one row makes a whole path
    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array(start), lambda told, i: F.concat(told, F.array(step(F.element_at(told, -1), i))))
    long = laws.where(law.isin(*LAWS) & F.col("y").isNotNull()).select(*keys, "law", dt.alias("_dt"), F.posexplode(path).alias("step", "_p")).where("step > 0")
    value, wide = F.col("_p.y"), Z * F.col("_p.s")
    told = long.withColumns({"value": value, "low": value - wide, "high": value + wide, "paused": (F.abs(value) > 1e-9) & (wide > limit * F.abs(value))})
    first = F.min(F.when(F.col("paused"), F.col("step"))).over(Window.partitionBy(*keys, "law"))
    confidence = F.greatest(F.lit(0.05), 1 / (1 + (F.col("step") - 1) * 0.05))
    return told.withColumn("_first", first).where(F.col("_first").isNull() | (F.col("step") <= F.col("_first"))).select(*keys, "law", "step", (F.col("step") * F.col("_dt")).alias("t"), "value", "low", "high", confidence.alias("confidence"), "paused")


def shared_periods(df: DataFrame, keys: list[str], name: str, position: str, value: str, window: int = 64, least: float = 0.0) -> DataFrame:
    """keys, a, b, period, coherence of each pair of named series: the period of the largest squared coherence, `least` at least; ties to the longer.

    position: whole numbers from 0, the same clock for all series. Coherence is averaged over
    windows that overlap by half (with one window it would be 1 for any two series), each less its mean and under a Hann
    taper. Only windows that a series fills count, and only pairs that share two windows or more.
    A task holds single windows; a long series is many of them.
    """
    half = window // 2
    rows = df.where(F.col(value).isNotNull() & (F.col(position) >= 0)).select(*keys, F.col(name).alias("name"), F.col(position).cast("long").alias("i"), F.col(value).cast("double").alias("x"))
    at = F.floor(F.col("i") / half)
    cut = rows.withColumn("w", F.explode(F.array(at, at - 1))).where("w >= 0").withColumn("j", F.col("i") - F.col("w") * half)
    whole = cut.groupBy(*keys, "name", "w").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.sort_array(F.collect_list(F.struct("j", "x"))).alias("l")).where(F.col("n") == window)
    taper = F.array(*[F.lit(0.5 - 0.5 * math.cos(2 * math.pi * j / (window - 1))) for j in range(window)])
    tapered = whole.select(*keys, "name", "w", F.zip_with(F.transform("l", lambda p: p["x"] - F.col("m")), taper, lambda x, t: x * t).alias("x"))
    waves = tapered.select("*", F.explode(F.sequence(F.lit(1), F.lit(half))).alias("f"))
    summed = lambda wave: F.aggregate(F.transform("x", lambda x, j: x * wave(2 * math.pi * F.col("f") * j / window)), F.lit(0.0), lambda s, x: s + x)
    lines = waves.select(*keys, "name", "w", "f", summed(F.cos).alias("re"), summed(F.sin).alias("im"))
    a, b = (lines.select(*keys, "w", "f", *[F.col(c).alias(f"{p}_{c}") for c in ("name", "re", "im")]) for p in "ab")
    met = a.join(b, [*keys, "w", "f"]).where("a_name < b_name").groupBy(*keys, F.col("a_name").alias("a"), F.col("b_name").alias("b"), "f").agg(
        F.count("*").alias("n"),
        F.sum(F.expr("a_re * b_re + a_im * b_im")).alias("re"), F.sum(F.expr("a_im * b_re - a_re * b_im")).alias("im"),
        F.sum(F.expr("a_re * a_re + a_im * a_im")).alias("aa"), F.sum(F.expr("b_re * b_re + b_im * b_im")).alias("bb"),
    )
    square = F.col("aa") * F.col("bb")
    told = met.where("n >= 2").withColumn("coherence", F.when(square > 1e-14, (F.col("re") ** 2 + F.col("im") ** 2) / square).otherwise(0.0))
    best = told.groupBy(*keys, "a", "b").agg(F.max_by(F.struct("f", "coherence"), F.struct(F.round("coherence", 9), -F.col("f"))).alias("p"))
    return best.select(*keys, "a", "b", (window / F.col("p.f")).alias("period"), "p.coherence").where(F.col("coherence") >= least)
