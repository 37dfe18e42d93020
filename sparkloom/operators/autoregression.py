"""Models of several series on their own past, from one pass of cross-products over all lags.

`gram` sums the products of all columns at all lags, slice by slice (see slices), so no task
holds a series and what is added up is a small matrix a slice. Every smaller model is a part of
that matrix: orders by AIC, vector autoregressions, F-tests of each series on each other. The
matrices are a row a series and are solved where they lie.

Rows with a null in any column are left out before they are numbered.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.lineage import kept

from . import slices


def _typed(df: DataFrame, keys: list[str], more: str) -> str:
    types = dict(df.dtypes)
    return ", ".join([*(f"`{k}` {types[k]}" for k in keys), more])


def _beside(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a with the row of b of its key; b has few rows, or goes by a shuffle."""
    return a.join(slices.sized(b), keys) if keys else a.crossJoin(F.broadcast(b))


def gram(rows: DataFrame, keys: list[str], lags: int, width: int = slices.WIDTH) -> DataFrame:
    """keys, n (places with all lags), mean (of each column) and g (row by row) of numbered rows: sums of products of 1 and of all columns, less their means, at lags `lags` ... 1 and 0."""
    mean = rows.select(*keys, F.posexplode("x").alias("c", "v")).groupBy(*keys, "c").agg(F.avg("v").alias("v"))
    mean = mean.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "v"))), lambda s: s["v"]).alias("mean"))
    mean = kept(mean)
    cut = _beside(slices.slices(rows, keys, lags, width), mean, keys).select(*keys, "xs", "mean")

    def sums(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                m = batch.column("mean")[i].values.to_numpy(zero_copy_only=False)
                x = batch.column("xs")[i].values.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(m)) - m
                n = max(0, min(len(x) - lags, width))
                w = np.lib.stride_tricks.sliding_window_view(x, (lags + 1, x.shape[1]))[:n, 0].reshape(n, -1) if n else np.zeros((0, (lags + 1) * len(m)))
                z = np.concatenate((np.ones((n, 1)), w), axis=1)
                out.append((z.T @ z).ravel())
            told = [batch.column(k) for k in keys]
            yield pa.RecordBatch.from_arrays([*told, pa.array(out, pa.list_(pa.float64()))], [*keys, "g"])

    each = cut.mapInArrow(sums, _typed(rows, keys, "g array<double>"))
    added = each.select(*keys, F.posexplode("g").alias("i", "v")).groupBy(*keys, "i").agg(F.sum("v").alias("v"))
    whole = added.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("g"))
    return _beside(whole, mean, keys).select(*keys, F.get("g", F.lit(0)).cast("long").alias("n"), "mean", "g")


def _matrix(g, k: int, lags: int) -> np.ndarray:
    size = 1 + k * (lags + 1)
    return np.asarray(g, float).reshape(size, size)


def _at(k: int, lags: int, lag: int, column: int) -> int:
    """The place of a column at a lag in the matrix."""
    return 1 + (lags - lag) * k + column


def _solved(m: np.ndarray, terms: list[int], targets: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the targets on the terms, and the cross-products of what is left."""
    b = np.linalg.lstsq(m[np.ix_(terms, terms)], m[np.ix_(terms, targets)], rcond=None)[0]
    left = m[np.ix_(targets, targets)] - m[np.ix_(targets, terms)] @ b
    return b, (left + left.T) / 2


def _terms(k: int, lags: int, order: int, columns=None) -> list[int]:
    return [0] + [_at(k, lags, lag, c) for lag in range(1, order + 1) for c in (columns if columns is not None else range(k))]


def orders(grams: DataFrame, keys: list[str], columns: list[str], lags: int) -> DataFrame:
    """keys, order and aic of vector autoregressions of every order from 0 to `lags`, all on the same places."""
    k = len(columns)

    def run(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                m, n = _matrix(r["g"], k, lags), r["n"]
                for p in range(lags + 1):
                    if n <= 1 + k * p:
                        continue
                    left = _solved(m, _terms(k, lags, p), [_at(k, lags, 0, c) for c in range(k)])[1] / n
                    sign, logdet = np.linalg.slogdet(left)
                    if sign > 0:
                        out.append((*[r[x] for x in keys], p, float(logdet + 2 / n * (k * k * p + k))))
            yield pd.DataFrame(out, columns=[*keys, "order", "aic"])

    return grams.mapInPandas(run, _typed(grams, keys, "order int, aic double"))


def vector_autoregression(df: DataFrame, keys: list[str], order: list[str], columns: list[str], most: int = 8, horizon: int = 12, least: int = 30, width: int = slices.WIDTH) -> tuple[DataFrame, DataFrame]:
    """The fits and the forecasts of each series of at least `least` complete rows.

    Fits: keys, n, order (by AIC over the same places, 1 at least), coefficients (of each
    column in turn: intercept, then all columns at lag 1, at lag 2, ...), and the strongest
    coupling at lag 1 between two columns (source, target, coupling). Forecasts: keys, h
    (1 to horizon), column and value.
    """
    k = len(columns)
    if k < 2:
        raise ValueError("a vector autoregression needs two columns at least")
    rows = slices.numbered(df, keys, order, columns)
    sizes = kept(rows.groupBy(*keys).agg(F.max("at").alias("last"), F.count("*").alias("rows")).where(F.col("rows") >= least))
    rows = kept(_beside(rows, sizes, keys))
    bears = sizes.select(*keys, F.greatest(F.lit(1), F.least(F.lit(most), F.floor((F.col("rows") - 1) / k) - 1)).cast("int").alias("bears"))
    fits = []
    for top in sorted(r["bears"] for r in bears.select("bears").distinct().collect()):
        part = _beside(rows, bears.where(F.col("bears") == top), keys)
        told = orders(gram(part, keys, top, width), keys, columns, top)
        best = told.groupBy(*keys).agg(F.min(F.struct("aic", "order")).alias("b")).select(*keys, F.greatest(F.lit(1), F.col("b.order")).alias("order"))
        fits.append(best)
    chosen = kept(_union(fits)) if fits else None
    if chosen is None or chosen.isEmpty():
        empty = df.limit(0).select(*keys)
        return (empty.select(*keys, *[F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("order", "int"), ("coefficients", "array<array<double>>"), ("source", "string"), ("target", "string"), ("coupling", "double"))]),
                empty.select(*keys, *[F.lit(None).cast(t).alias(c) for c, t in (("h", "int"), ("column", "string"), ("value", "double"))]))
    # each order's own places: n - order of them
    found = [_fitted(gram(_beside(rows, chosen.where(F.col("order") == p), keys).drop("order"), keys, p, width), keys, columns, p) for p in sorted(r["order"] for r in chosen.select("order").distinct().collect())]
    fitted = kept(_union(found))
    last = _beside(rows, chosen, keys).where(F.col("last") - F.col("at") < F.col("order"))
    recent = last.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("recent"))
    return fitted, _beside(fitted, recent, keys).mapInPandas(_forecaster(keys, columns, horizon), _typed(fitted, keys, "h int, column string, value double"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _fitted(grams: DataFrame, keys: list[str], columns: list[str], p: int) -> DataFrame:
    k = len(columns)

    def run(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                mean = np.asarray(r["mean"], float)
                b = _solved(_matrix(r["g"], k, p), _terms(k, p, p), [_at(k, p, 0, c) for c in range(k)])[0]
                slopes = b[1:].reshape(p, k, k)  # lag, column it comes from, column it goes to
                # products were taken about the means
                start = mean + b[0] - sum(mean @ slopes[lag] for lag in range(p))
                coupled = slopes[0].T.copy()
                np.fill_diagonal(coupled, 0.0)
                to, of = divmod(int(np.abs(coupled).argmax()), k)
                out.append((*[r[x] for x in keys], r["n"], p, [[float(start[c]), *slopes[:, :, c].ravel().tolist()] for c in range(k)], columns[of], columns[to], float(coupled[to, of])))
            yield pd.DataFrame(out, columns=[*keys, "n", "order", "coefficients", "source", "target", "coupling"])

    return grams.mapInPandas(run, _typed(grams, keys, "n long, order int, coefficients array<array<double>>, source string, target string, coupling double"))


def _forecaster(keys: list[str], columns: list[str], horizon: int):
    def run(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                b, past = np.array([list(c) for c in r["coefficients"]]), [np.asarray(x, float) for x in r["recent"]]
                for h in range(1, horizon + 1):
                    x = np.concatenate(([1.0], *past[: -r["order"] - 1 : -1]))
                    past.append(b @ x)
                    out += [(*[r[x] for x in keys], h, c, float(v)) for c, v in zip(columns, past[-1], strict=True)]
            yield pd.DataFrame(out, columns=[*keys, "h", "column", "value"])

    return run


def f_tail(f: float, a: float, b: float) -> float:
    """Upper tail of the F distribution with a and b degrees of freedom, by the continued fraction of the incomplete beta function."""
    if not f > 0 or b <= 0:
        return 1.0
    p, q, x = b / 2, a / 2, b / (b + a * f)
    flip = x > (p + 1) / (p + q + 2)
    if flip:
        p, q, x = q, p, 1 - x
    front = math.exp(math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) + p * math.log(max(x, 1e-300)) + q * math.log1p(-x)) / p if 0 < x < 1 else 0.0
    first = 1 - (p + q) * x / (p + 1)
    c, d = 1.0, 1 / (first if abs(first) > 1e-300 else 1e-300)
    total = d
    for m in range(1, 400):
        for top in (m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = c if abs(c) > 1e-300 else 1e-300
            total *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, max(0.0, 1 - front * total if flip else front * total))


def granger(df: DataFrame, keys: list[str], order: list[str], columns: list[str], most: int = 4, width: int = slices.WIDTH) -> DataFrame:
    """keys, cause, effect, lag, n, f and p: whether the last `lag` values of one column tell more of another than its own do, for each lag up to `most` and each ordered pair, all on the same places. Pairs without enough places are left out."""
    k = len(columns)
    rows = slices.numbered(df, keys, order, columns)

    def run(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                m, n = _matrix(r["g"], k, most), r["n"]
                for j, effect in enumerate(columns):
                    target = [_at(k, most, 0, j)]
                    for lag in range(1, most + 1):
                        rest = n - 2 * lag - 1
                        if rest <= 0:
                            continue
                        own = float(_solved(m, _terms(k, most, lag, [j]), target)[1][0, 0])
                        for i, cause in enumerate(columns):
                            if i == j:
                                continue
                            both = float(_solved(m, _terms(k, most, lag, [j, i]), target)[1][0, 0])
                            ratio = max(0.0, (own - both) / lag / (both / rest)) if both > 1e-12 * max(own, 1e-300) else math.inf
                            out.append((*[r[x] for x in keys], cause, effect, lag, n, ratio, f_tail(ratio, lag, rest) if math.isfinite(ratio) else 0.0))
            yield pd.DataFrame(out, columns=[*keys, "cause", "effect", "lag", "n", "f", "p"])

    return gram(rows, keys, most, width).mapInPandas(run, _typed(rows, keys, "cause string, effect string, lag int, n long, f double, p double"))


def transfer_entropy(df: DataFrame, keys: list[str], order: list[str], columns: list[str], lag: int = 1, bins: int = 6, width: int = slices.WIDTH) -> DataFrame:
    """keys, cause, effect, n and te (nats): what the cause's value `lag` places before tells of the effect's, given the effect's own at that lag; all in `bins` equal bins, every pair from one joint count."""
    k = len(columns)
    w = slices.windows(slices.numbered(df, keys, order, columns), keys, lag + 1, width)
    part = lambda start: F.transform(F.slice("w", start + 1, k), lambda v: v)
    both = kept(w.select(*keys, part(0).alias("b"), part(lag * k).alias("a")))
    ends = both.groupBy(*keys).agg(*[f(F.get(s, F.lit(i))).alias(f"{n}{s}{i}") for s in "ab" for i in range(k) for n, f in (("lo", F.min), ("hi", F.max))])

    def cell(s: str, i: int):
        lo, hi = F.col(f"lo{s}{i}"), F.col(f"hi{s}{i}")
        return F.when(hi > lo, F.least(F.lit(bins - 1), F.floor((F.get(s, F.lit(i)) - lo) / (hi - lo) * bins))).otherwise(0).cast("int")

    placed = _beside(both, ends, keys)
    pairs = [F.struct(F.lit(columns[i]).alias("cause"), F.lit(columns[j]).alias("effect"), cell("b", i).alias("x"), cell("a", j).alias("y"), cell("b", j).alias("z")) for i in range(k) for j in range(k) if i != j]
    joint = placed.select(*keys, F.explode(F.array(*pairs)).alias("p")).select(*keys, "p.*").groupBy(*keys, "cause", "effect", "x", "y", "z").agg(F.count("*").alias("n"))
    of = [*keys, "cause", "effect"]
    joint = kept(joint)  # bins cubed rows for each pair of columns, at most

    def summed(name: str, *by: str) -> DataFrame:
        return joint.groupBy(*of, *by).agg(F.sum("n").alias(name))

    told = joint
    for name, by in (("nz", ["z"]), ("nxz", ["x", "z"]), ("nyz", ["y", "z"]), ("total", [])):
        told = told.join(summed(name, *by), [*of, *by])
    term = F.col("n") / F.col("total") * F.log(F.col("n") * F.col("nz") / (F.col("nxz") * F.col("nyz")))
    return told.groupBy(*of).agg(F.first("total").alias("n"), F.sum(term).alias("te"))
