"""How far results hold: bands over perturbed inputs, one weight moved at a time, forecasts from rolling
origins, a target dealt out anew, and the choice among regressors on rows held out."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.lineage import kept
from sparkloom.operators import forecasting
from sparkloom.operators.estimates import _uniform, ols
from sparkloom.operators.preflight import numbered

SHARES = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}
#: Relative changes of a weight.
CHANGES = (-0.2, -0.1, 0.1, 0.2)


def perturbed(df: DataFrame, key: str, columns: list[str], runs: int, noise: float = 0.02, seed: int = 7) -> DataFrame:
    """The rows `runs` times over (run from 1), each column times 1 + a normal step of deviation `noise`, told by a hash of seed, run, column and key: rows of one key get one step. Nulls stay null.

    Rows are dealt out before they are repeated: a small file is read by one or two tasks, which would work out all runs.
    """
    step = lambda c: F.sqrt(-2 * F.log1p(-_uniform(seed, F.col("run"), c, F.col(key), "r"))) * F.cos(2 * math.pi * _uniform(seed, F.col("run"), c, F.col(key), "a"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = df.repartition(parts, key).withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    return many.withColumns({c: F.col(c).cast("double") * (1 + noise * step(c)) for c in columns})


def ensemble(df: DataFrame, key: str, columns: list[str], figures: dict[str, Column], runs: int = 200, noise: float = 0.02, seed: int = 7) -> DataFrame:
    """figure, its quantiles, mean and sd (population) over runs on perturbed inputs.

    figures: aggregates by name. Each run's are partial sums before anything is shuffled, so what travels is a row for each
    task and run. No rows for an empty table.
    """
    told = perturbed(df, key, columns, runs, noise, seed).groupBy("run").agg(*[f.alias(n) for n, f in figures.items()])
    long = told.select(F.inline(F.array(*[F.struct(F.lit(n).alias("figure"), F.col(n).cast("double").alias("x")) for n in figures])))
    return long.groupBy("figure").agg(*[F.percentile("x", p).alias(n) for n, p in SHARES.items()], F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))


def weight_changes(df: DataFrame, weights: dict[str, float], figure: Callable[[dict[str, float]], Column], changes: tuple[float, ...] = CHANGES) -> DataFrame:
    """weight, change, base and delta of a figure (an aggregate of the rows, given the weights) when one weight at a time is moved by a share of itself: all from one pass."""
    moved = [(name, c, {**weights, name: w * (1 + c)}) for name, w in weights.items() for c in changes]
    told = df.agg(figure(weights).cast("double").alias("base"), *[figure(w).cast("double").alias(f"_{i}") for i, (_, _, w) in enumerate(moved)])
    parts = [F.struct(F.lit(n).alias("weight"), F.lit(c).alias("change"), (F.col(f"_{i}") - F.col("base")).alias("delta")) for i, (n, c, _) in enumerate(moved)]
    return told.select("base", F.inline(F.array(*parts))).select("weight", "change", "base", "delta")


def rolling_errors(df: DataFrame, keys: list[str], order: list[str], value: str, horizon: int, origins: int = 3, methods: dict | None = None) -> DataFrame:
    """keys, method, origins and rmse: the error of each method over `horizon` rows from several origins, a horizon apart, the last one at the end.

    The origins are copies of the series under a further key, so all are fitted in one job. An origin with fewer than
    two horizons of rows before it is left out; a method that tells nothing for a series has no row.
    """
    rows = forecasting.placed(df, keys, order, value).withColumn("origin", F.explode(F.sequence(F.lit(1), F.lit(origins)))).withColumn("at", F.col("n") - F.col("origin") * horizon).where(F.col("at") >= 2 * horizon)
    rows = kept(rows)
    wide = [*keys, "origin"]
    known = rows.where(F.col("i") <= F.col("at")).select(*wide, "i", F.col("at").alias("n"), "x")
    held = rows.where((F.col("i") > F.col("at")) & (F.col("i") <= F.col("at") + horizon)).select(*wide, (F.col("i") - F.col("at")).alias("h"), "x")
    tried = None
    for method in (methods or forecasting.METHODS).values():
        one = method(known, wide, horizon)
        tried = one if tried is None else tried.unionByName(one)
    square = F.avg((F.col("x") - F.col("value")) ** 2)
    return tried.join(held, [*wide, "h"]).groupBy(*wide, "method").agg(F.sqrt(square).alias("e")).groupBy(*keys, "method").agg(F.count("*").alias("origins"), F.avg("e").alias("rmse"))


def rolling_chosen(df: DataFrame, keys: list[str], order: list[str], value: str, horizon: int, origins: int = 3) -> DataFrame:
    """The forecast of the method of least mean error over rolling origins, ties to the earlier name; a series too short for an origin has the flat one, rmse null."""
    best = rolling_errors(df, keys, order, value, horizon, origins).groupBy(*keys).agg(F.min(F.struct(F.round("rmse", 6).alias("rmse"), "method")).alias("b"))
    rows = forecasting.placed(df, keys, order, value)
    told = None
    for method in forecasting.METHODS.values():
        one = method(rows, keys, horizon)
        told = one if told is None else told.unionByName(one)
    named = rows.select(*keys).distinct().join(best, keys, "left").select(*keys, F.coalesce("b.method", F.lit("flat")).alias("method"), "b.rmse")
    return told.join(named, [*keys, "method"])


def dealt(df: DataFrame, key: str, target: str, seed: int = 7) -> DataFrame:
    """The rows, each with the target of another place: keys in the order of one hash meet targets in the order of another. Every target is used once; equal keys are told apart by their target."""
    place = lambda tag: _uniform(seed, tag, F.col(key), F.col(target))
    here = numbered(df.withColumn("_h", place("here")), ["_h", key]).drop("_h", "total", target)
    there = numbered(df.select(key, F.col(target).alias("_t")).withColumn("_h", _uniform(seed, "there", F.col(key), F.col("_t"))), ["_h", key]).select("pos", F.col("_t").alias(target))
    return here.join(there, "pos").drop("pos")


def shuffled_fit(df: DataFrame, key: str, target: str, features: list[str], seed: int = 7) -> DataFrame:
    """n, r2 and r2_shuffled of a linear fit: what is left of it when the target is dealt out anew should be near none."""
    rows = df.select(key, target, *features).dropna()
    fit = lambda d, n: ols(d, target, features).limit(1).select("n", F.col("r2").alias(n))
    return fit(rows, "r2").join(fit(dealt(rows, key, target, seed), "r2_shuffled"), "n")


def regressors(df: DataFrame, key: str, target: str, features: list[str], held: float = 0.25, seed: int = 42, trees: int = 20) -> DataFrame:
    """model, n_train, n_test, rmse, mae, r2 and best of a linear fit, a forest and boosted trees on rows held out by a hash of their key; ties to the earlier name."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    flat = df.select(F.col(key).alias("key"), F.col(target).cast("double").alias("label"), *[F.col(f).cast("double").alias(f) for f in features]).dropna()
    rows = kept(VectorAssembler(inputCols=features, outputCol="features").transform(flat).select((_uniform(seed, F.col("key")) < held).alias("held"), "label", "features"))
    train, test = rows.where("NOT held"), rows.where("held")
    n = train.count()
    models = {"boosted_trees": GBTRegressor(maxIter=trees, seed=seed), "forest": RandomForestRegressor(numTrees=trees, seed=seed), "linear": LinearRegression()}
    found = None
    for name, model in models.items():
        miss = F.col("label") - F.col("prediction")
        spread = F.var_pop("label")
        one = model.fit(train).transform(test).agg(F.lit(name).alias("model"), F.lit(n).alias("n_train"), F.count("*").alias("n_test"), F.sqrt(F.avg(miss**2)).alias("rmse"), F.avg(F.abs(miss)).alias("mae"), F.when(spread > 0, 1 - F.avg(miss**2) / spread).alias("r2"))
        found = one if found is None else found.unionByName(one)
    found = kept(found)
    best = found.orderBy(F.round("rmse", 9), "model").limit(1).select("model", F.lit(True).alias("best"))
    return found.join(F.broadcast(best), "model", "left").fillna(False, ["best"])
