"""Ordered series: every operator takes the series' key and its order; windows stay within one series."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lagged(df: DataFrame, keys: list[str], order: list[str], value: str, lags: list[int]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"lag{k}": F.lag(value, k).over(w) for k in lags})


def derivatives(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """d1 (central difference, one-sided at the ends) and d2 (second difference) for evenly spaced rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before, after, x = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return df.withColumns({"d1": F.when(before.isNull(), after - x).when(after.isNull(), x - before).otherwise((after - before) / 2), "d2": after - 2 * x + before})


def segments(df: DataFrame, keys: list[str], order: list[str], starts: Column) -> DataFrame:
    """segment: numbered runs of rows; a row where `starts` is true begins one. `starts` may use `_before`, the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("segment", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w))


def ar1(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """phi = population covariance of neighbours / population variance of the earlier ones, by series."""
    pairs = lagged(df, keys, order, value, [1]).where("lag1 IS NOT NULL")
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), (F.covar_pop(value, "lag1") / F.var_pop("lag1")).alias("phi"))


def cross_correlation(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, max_lag: int) -> DataFrame:
    """lag and r: the correlation of x with y that many rows later, one pass over the windows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    shifted = df.withColumns({f"_y{k + max_lag}": F.lead(y, k).over(w) if k >= 0 else F.lag(y, -k).over(w) for k in range(-max_lag, max_lag + 1)})
    parts = [F.struct(F.lit(k).alias("lag"), F.corr(F.when(F.col(f"_y{k + max_lag}").isNotNull(), F.col(x)), F.col(f"_y{k + max_lag}")).alias("r")) for k in range(-max_lag, max_lag + 1)]
    return shifted.groupBy(*keys).agg(F.array(*parts).alias("p")).select(*keys, F.inline("p"))


def drawdowns(df: DataFrame, keys: list[str], order: list[str], returns: str) -> DataFrame:
    """equity (compound product of 1 + return) and drawdown (equity less its highest so far)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    equity = df.withColumn("equity", F.exp(F.sum(F.log1p(returns)).over(w)))
    return equity.withColumn("drawdown", F.col("equity") - F.max("equity").over(w))


def hysteresis(df: DataFrame, keys: list[str], order: list[str], value: str, enter: float, leave: float) -> DataFrame:
    """position: 1 from a value above `enter` until one below `leave`, else 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    told = F.when(F.col(value) > enter, 1).when(F.col(value) < leave, 0)
    return df.withColumn("position", F.coalesce(F.last(told, ignorenulls=True).over(w), F.lit(0)))


def _per_series(df: DataFrame, keys: list[str], order: list[str], value: str, kernel, schema: str) -> DataFrame:
    """A kernel over each series as an array; a series is taken to fit one task, as its kernel is sequential."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out = kernel(pdf[value].to_numpy(float))
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return df.select(*keys, *order, value).where(F.col(value).isNotNull()).groupBy(*keys).applyInPandas(run, schema)


def cusum(df: DataFrame, keys: list[str], key_schema: str, order: list[str], value: str, slack: float = 0.5, limit: float = 8.0) -> DataFrame:
    """at (place in the series) and side (+1 or -1) of each alarm; the sums start anew after one, from the mean so far.

    Rows come in order of key and time, and a task holds the sums and the last 81 values only.
    """
    g = Window.partitionBy(*keys)
    x = F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull()).select(*keys, *order, x.alias("_x"), (F.row_number().over(g.orderBy(*order)) - 1).cast("long").alias("at"))
    rows = rows.withColumns({"_n": F.count("*").over(g), "_sd": F.stddev_pop("_x").over(g)})
    rows = rows.withColumn("_mean", F.avg(F.when(F.col("at") < F.greatest(F.lit(1), F.floor(F.col("_n") / 10)), F.col("_x"))).over(g))

    def run(batches):
        last: deque = deque(maxlen=81)
        mean = up = down = 0.0
        for batch in batches:
            found = []
            for row, (v, at, sd, start) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_x", "at", "_sd", "_mean")), strict=True)):
                if at == 0:
                    mean, up, down = start, 0.0, 0.0
                    last.clear()
                last.append(v)
                z = (v - mean) / (sd or 1.0)
                up, down = max(0.0, up + z - slack), max(0.0, down - z - slack)
                if max(up, down) > limit:
                    found.append((row, 1 if up > down else -1))
                    mean, up, down = float(np.mean(last)), 0.0, 0.0
            alarms = batch.take(pa.array([i for i, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(alarms.column(k) for k in keys), alarms.column("at"), pa.array([side for _, side in found], pa.int64())], [*keys, "at", "side"])

    return rows.sortWithinPartitions(*keys, "at").select(*keys, "at", "_x", "_sd", "_mean").mapInArrow(run, f"{key_schema}, at long, side long")


def matrix_profile(df: DataFrame, keys: list[str], key_schema: str, order: list[str], value: str, window: int) -> DataFrame:
    """at, distance and nearest: each window's nearest other window by z-normalised distance, half a window apart at least."""

    def kernel(x: np.ndarray) -> pd.DataFrame:
        n = len(x) - window + 1
        if n < 2:
            return pd.DataFrame({"at": [], "distance": [], "nearest": []}).astype({"at": "int64", "nearest": "int64", "distance": float})
        w = np.lib.stride_tricks.sliding_window_view(x, window)
        z = (w - w.mean(axis=1, keepdims=True)) / np.where(w.std(axis=1, keepdims=True) > 1e-12, w.std(axis=1, keepdims=True), 1.0)
        out, near = np.empty(n), np.empty(n, np.int64)
        for a in range(0, n, 256):
            d = np.sqrt(np.maximum(0, (z[a : a + 256] ** 2).sum(axis=1)[:, None] + (z**2).sum(axis=1)[None] - 2 * z[a : a + 256] @ z.T))
            i = np.arange(a, min(a + 256, n))
            d[np.abs(i[:, None] - np.arange(n)[None]) < max(1, window // 2)] = np.inf
            near[i], out[i] = d.argmin(axis=1), d.min(axis=1)
        return pd.DataFrame({"at": np.arange(n), "distance": out, "nearest": near})

    return _per_series(df, keys, order, value, kernel, f"{key_schema}, at long, distance double, nearest long")


def spectral_entropy(df: DataFrame, keys: list[str], key_schema: str, order: list[str], value: str) -> DataFrame:
    """Entropy of the normalised power spectrum, from 0 (one tone) to 1 (noise)."""

    def kernel(x: np.ndarray) -> pd.DataFrame:
        p = np.abs(np.fft.rfft(x - x.mean()))[1:] ** 2
        p = p[p > 0] / p.sum() if p.sum() > 0 else np.ones(1)
        return pd.DataFrame({"n": [len(x)], "entropy": [float(-(p * np.log(p)).sum() / np.log(max(2, len(x) // 2)))]})

    return _per_series(df, keys, order, value, kernel, f"{key_schema}, n long, entropy double")


def kalman(df: DataFrame, keys: list[str], key_schema: str, order: list[str], value: str, q: float = 0.3, r: float = 0.7) -> DataFrame:
    """at, level and variance of a local-level filter with noise as shares of the series' variance."""

    def kernel(x: np.ndarray) -> pd.DataFrame:
        s2 = x.var() or 1.0
        level, p, out = x[0], s2, []
        for v in x:
            p += q * s2
            gain = p / (p + r * s2)
            level, p = level + gain * (v - level), (1 - gain) * p
            out.append((level, p))
        return pd.DataFrame({"at": np.arange(len(x)), "level": [o[0] for o in out], "variance": [o[1] for o in out]})

    return _per_series(df, keys, order, value, kernel, f"{key_schema}, at long, level double, variance double")
