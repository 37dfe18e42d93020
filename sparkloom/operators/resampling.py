"""Resampling by cluster: every replicate weighs whole clusters, and the weights are worked out where the rows lie.

The weight of a cluster in a replicate depends on both and a seed alone, by a hash, so tasks
need no shared random state and a lost task gives the same again. A task multiplies the
weights of its rows (rows x replicates, a slice at a time) with their values and returns the
sums of each replicate: what is shuffled is tasks x replicates numbers, whatever the rows, and
no rows are grouped together to stand for others.

Kinds of weights: `poisson` (how often a cluster is drawn, Poisson with mean 1), `sign` (+1 or
-1). Permutations are arithmetic ones of the places 0 ... n - 1 (a Feistel network walked until
it lands inside), so nothing is sorted for a replicate.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.lineage import kept

from . import estimates, slices

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Cumulative chances of 0, 1, 2, ... draws.
_DRAWS = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
#: Values that every task may be sent.
SENT = 4_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x + _A
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def weights(clusters: np.ndarray, replicates: np.ndarray, seed: int, kind: str) -> np.ndarray:
    """Of each cluster (a 64-bit number) its weight in each replicate."""
    mixed = _mixed(_mixed(clusters.astype(np.int64).view(np.uint64) ^ _mixed(np.array([seed], np.uint64)))[:, None] + _mixed(replicates.astype(np.uint64)))
    if kind == "sign":
        return np.where(mixed >> np.uint64(63), 1.0, -1.0)
    return np.searchsorted(_DRAWS, (mixed >> np.uint64(11)).astype(np.float64) / (1 << 53), "right").astype(np.float64)


def replicate_sums(df: DataFrame, cluster: Column, values: dict[str, Column], replicates: int = 999, seed: int = 42, kind: str = "poisson", by: Column | None = None) -> DataFrame:
    """replicate (from 1), by (if asked for) and the weighted sums of the values in each replicate. Null clusters are one cluster, null values nothing."""
    names = list(values)
    rows = df.select(F.xxhash64(cluster).alias("cluster"), (F.lit(0) if by is None else by).alias("by"), *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(n) for n, v in values.items()])
    numbers = np.arange(1, replicates + 1)
    kind_of = rows.schema["by"].dataType.simpleString()

    def sums(batches):
        total: dict = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                w = weights(part.column(0).to_numpy(), numbers, seed, kind)
                x = np.stack([part.column(i + 2).to_numpy() for i in range(len(names))], axis=1)
                groups = part.column(1).to_pylist()
                codes, at = {}, np.empty(len(groups), np.int64)
                for i, g in enumerate(groups):
                    at[i] = codes.setdefault(g, len(codes))
                for g, code in codes.items():
                    some = at == code
                    found = w[some].T @ x[some]
                    total[g] = total[g] + found if g in total else found
            if len(total) * replicates > 2_000_000:
                yield from told(total)
                total = {}
        yield from told(total)

    def told(total: dict):
        for g, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([g] * replicates, rows_type), *[pa.array(x[:, i]) for i in range(len(names))]], ["replicate", "by", *names])

    from pyspark.sql.pandas.types import to_arrow_type

    rows_type = to_arrow_type(rows.schema["by"].dataType)
    each = rows.mapInArrow(sums, f"replicate int, by {kind_of}, " + ", ".join(f"`{n}` double" for n in names))
    out = each.groupBy("replicate", "by").agg(*[F.sum(n).alias(n) for n in names])
    return out.drop("by") if by is None else out


def interval(replicated: DataFrame, statistic: str, level: float = 0.95) -> DataFrame:
    """n_replicates, low, high and sd of a column with a row a replicate."""
    return replicated.agg(F.count(statistic).alias("n_replicates"), F.percentile(statistic, F.lit((1 - level) / 2)).alias("low"), F.percentile(statistic, F.lit((1 + level) / 2)).alias("high"), F.stddev_samp(statistic).alias("sd"))


def bca(df: DataFrame, cluster: Column, values: dict[str, Column], statistic: Callable[[Callable[[str], Column]], Column], replicates: int = 2000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """estimate, n_replicates, low and high: a bias-corrected and accelerated interval of a statistic of sums, clusters drawn whole. The acceleration is that of leaving out each cluster in turn."""
    per = kept(df.groupBy(F.xxhash64(cluster).alias("c")).agg(*[F.sum(F.coalesce(v.cast("double"), F.lit(0.0))).alias(n) for n, v in values.items()]))
    totals = per.agg(*[F.sum(n).alias(f"t_{n}") for n in values])
    estimate = totals.select(statistic(lambda n: F.col(f"t_{n}")).alias("e")).first()["e"]
    out = per.sparkSession.createDataFrame
    schema = "estimate double, n_replicates long, low double, high double"
    if estimate is None:
        return out([(None, 0, None, None)], schema)
    left = per.crossJoin(F.broadcast(totals)).select(statistic(lambda n: F.col(f"t_{n}") - F.col(n)).alias("j"))
    mean = left.agg(F.avg("j")).first()[0]
    gap = F.lit(float(mean)) - F.col("j")
    cubes, squares = left.agg(F.sum(gap**3), F.sum(gap**2)).first()
    a = cubes / (6 * squares**1.5) if squares else 0.0
    drawn = kept(replicate_sums(per, F.col("c"), {n: F.col(n) for n in values}, replicates, seed).select(statistic(F.col).alias("v")).where("v IS NOT NULL"))
    n, below, ties = drawn.agg(F.count("*"), F.count_if(F.col("v") < estimate), F.count_if(F.col("v") == estimate)).first()
    normal = NormalDist()
    share = min(max((below + ties / 2) / max(1, n), 0.5 / max(1, n)), 1 - 0.5 / max(1, n))
    z0 = normal.inv_cdf(share)
    ends = []
    for q in ((1 - level) / 2, (1 + level) / 2):
        z = z0 + normal.inv_cdf(q)
        ends.append(normal.cdf(z0 + z / (1 - a * z)))
    low, high = drawn.agg(*[F.percentile("v", F.lit(p)) for p in ends]).first()
    return out([(float(estimate), int(n), low, high)], schema)


def panel_share_intervals(df: DataFrame, entity: str, time: str, value: str, replicates: int = 200, level: float = 0.95, seed: int = 42) -> DataFrame:
    """part (entity, time, residual), share, low and high: shares of the sum of squares, with intervals by drawing whole entities."""
    rows = df.dropna(subset=[entity, time, value])
    e = kept(rows.groupBy(entity).agg(F.count("*").cast("double").alias("n"), F.sum(value).cast("double").alias("s"), F.sum(F.col(value).cast("double") ** 2).alias("q")))
    cells = kept(rows.groupBy(entity, time).agg(F.count("*").cast("double").alias("n"), F.sum(value).cast("double").alias("s")))

    def shares(whole: DataFrame, times: DataFrame, on: list[str]) -> DataFrame:
        met = whole.join(times, on) if on else whole.crossJoin(times)
        # a replicate may draw no entity
        base = F.try_divide(F.col("s") ** 2, F.col("n"))
        total = F.col("q") - base
        a, b = (F.col("b") - base) / total, (F.col("bt") - base) / total
        return met.where(total > 0).select(*on, a.alias("entity"), b.alias("time"), F.greatest(F.lit(0.0), 1 - a - b).alias("residual"))

    parts = {"n": F.col("n"), "s": F.col("s"), "q": F.col("q"), "b": F.col("s") ** 2 / F.col("n")}
    drawn = replicate_sums(e, F.col(entity), parts, replicates, seed)
    by_time = replicate_sums(cells, F.col(entity), {"n": F.col("n"), "s": F.col("s")}, replicates, seed, by=F.col(time))
    by_time = by_time.where("n > 0").groupBy("replicate").agg(F.sum(F.col("s") ** 2 / F.col("n")).alias("bt"))
    found = kept(shares(drawn, by_time, ["replicate"]))
    point = e.agg(*[F.sum(c).alias(n) for n, c in parts.items()])
    times = cells.groupBy(time).agg(F.sum("n").alias("n"), F.sum("s").alias("s")).agg(F.sum(F.col("s") ** 2 / F.col("n")).alias("bt"))
    names = ("entity", "time", "residual")
    ends = found.agg(*[F.percentile(c, F.lit(p)).alias(f"{w}_{c}") for c in names for w, p in (("low", (1 - level) / 2), ("high", (1 + level) / 2))])
    told = shares(point, times, []).crossJoin(ends)
    return told.select(F.inline(F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("share"), F.col(f"low_{c}").alias("low"), F.col(f"high_{c}").alias("high")) for c in names])))


def wild_cluster(panel: DataFrame, entity: str, time: str, treated: str, outcome: str, replicates: int = 999, seed: int = 42) -> DataFrame:
    """effect, p, n, entities, pretrend and pretrend_p of a balanced panel with both fixed effects: the wild bootstrap by entity with the null imposed.

    Under the null what is left of the outcome (`_y`) is turned by a sign for each entity; as the
    demeaned treatment is free of both effects, a replicate's effect is the signed sum of the
    entities' scores. pretrend is the slope over time of the gap between ever and never treated
    entities before any treatment, its p by the same signs over entities.
    """
    rows = panel.dropna(subset=[entity, time, treated, outcome]).select(F.col(entity).alias("e"), F.col(time).alias("t"), F.col(treated).cast("double").alias("x"), F.col(outcome).cast("double").alias("y"))
    by = rows.groupBy("e").agg(F.avg("x").alias("xe"), F.avg("y").alias("ye"), F.max("x").alias("ever"))
    times = kept(rows.groupBy("t").agg(F.avg("x").alias("xt"), F.avg("y").alias("yt"), F.max("x").alias("post")))
    whole = rows.agg(F.avg("x").alias("xm"), F.avg("y").alias("ym"))
    flat = rows.join(by, "e").join(slices.sized(times), "t").crossJoin(F.broadcast(whole))
    flat = kept(flat.select("e", "t", "y", "ever", "post", (F.col("x") - F.col("xe") - F.col("xt") + F.col("xm")).alias("_x"), (F.col("y") - F.col("ye") - F.col("yt") + F.col("ym")).alias("_y")))
    score = kept(flat.groupBy("e").agg(F.sum(F.col("_x") * F.col("_y")).alias("s"), F.sum(F.col("_x") ** 2).alias("q"), F.count("*").alias("n")))
    told = score.agg(F.sum("s"), F.sum("q"), F.sum("n"), F.count("*")).first()
    schema = "effect double, p double, n long, entities long, pretrend double, pretrend_p double"
    if not told[1]:
        return panel.sparkSession.createDataFrame([(None, None, told[2] or 0, told[3], None, None)], schema)
    effect = told[0] / told[1]
    drawn = replicate_sums(score, F.col("e"), {"s": F.col("s")}, replicates, seed, "sign")
    beyond = drawn.where(F.abs("s") >= abs(told[0]) * (1 - 1e-12)).count()
    slope = slope_p = None
    before = kept(flat.where("post = 0").select("e", F.col("t").cast("double").alias("t"), "y", "ever"))
    mid = before.select("t").distinct().agg(F.avg("t"), F.count("*")).first()
    if (mid[1] or 0) > 1:
        # of each entity its own slope; the gap's slope is the difference of their means
        own = before.groupBy("e").agg(F.max("ever").alias("ever"), F.regr_slope("y", "t").alias("b")).where("b IS NOT NULL")
        own = kept(own)
        means = {r["ever"]: (r["m"], r["k"]) for r in own.groupBy((F.col("ever") > 0).cast("int").alias("ever")).agg(F.avg("b").alias("m"), F.count("*").alias("k")).collect()}
        if len(means) == 2:
            slope = means[1][0] - means[0][0]
            pooled = own.agg(F.avg("b")).first()[0]
            half = own.withColumn("u", (F.col("b") - F.lit(float(pooled))) * F.when(F.col("ever") > 0, F.lit(1.0 / means[1][1])).otherwise(F.lit(-1.0 / means[0][1])))
            turned = replicate_sums(half, F.col("e"), {"u": F.col("u")}, replicates, seed + 1, "sign")
            slope_p = (1 + turned.where(F.abs("u") >= abs(slope) * (1 - 1e-12)).count()) / (replicates + 1)
    return panel.sparkSession.createDataFrame([(float(effect), (1 + beyond) / (replicates + 1), told[2], told[3], slope, slope_p)], schema)


def doubly_robust(df: DataFrame, key: Column, treatment: str, outcome: str, covariates: list[str], clip: float = 1e-3, replicates: int = 999, level: float = 0.95, seed: int = 42) -> DataFrame:
    """effect, se, low and high of the doubly robust effect: the mean of the rows' contributions, drawn by the clusters of `key`."""
    rows = df.dropna(subset=[treatment, outcome, *covariates])
    scale = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(covariates)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(covariates)]).first()
    names = [f"x{i}" for i in range(len(covariates))]
    flat = kept(rows.select(F.xxhash64(key).alias("c"), F.col(treatment).cast("double").alias("t"), F.col(outcome).cast("double").alias("y"), *[((F.col(c) - scale[f"m{i}"]) / (scale[f"s{i}"] or 1.0)).alias(n) for i, (c, n) in enumerate(zip(covariates, names, strict=True))]))

    def line(b) -> Column:
        out = F.lit(float(b[0]))
        for n, v in zip(names, b[1:], strict=True):
            out = out + F.col(n) * float(v)
        return out

    e = F.least(F.lit(1 - clip), F.greatest(F.lit(clip), 1 / (1 + F.exp(-line(estimates.logistic(flat, "t", names))))))
    arms = []
    for arm in (0.0, 1.0):
        fitted = {r["term"]: r["estimate"] for r in estimates.ols(flat.where(F.col("t") == arm), "y", names).collect()}
        arms.append(line([fitted["intercept"], *[fitted[n] for n in names]]))
    part = arms[1] - arms[0] + F.col("t") * (F.col("y") - arms[1]) / e - (1 - F.col("t")) * (F.col("y") - arms[0]) / (1 - e)
    per = kept(flat.select("c", part.alias("psi")).groupBy("c").agg(F.sum("psi").alias("s"), F.count("*").cast("double").alias("n")))
    drawn = replicate_sums(per, F.col("c"), {"s": F.col("s"), "n": F.col("n")}, replicates, seed).select(F.try_divide("s", "n").alias("v"))
    point = per.agg((F.sum("s") / F.sum("n")).alias("effect"))
    return point.crossJoin(interval(drawn, "v", level)).select("effect", F.col("sd").alias("se"), "low", "high")


def permuted(n: int, replicate: int, seed: int, places: np.ndarray) -> np.ndarray:
    """Where a replicate's permutation of 0 ... n - 1 sends the places."""
    half = max(1, math.ceil(max(1, (n - 1).bit_length()) / 2))
    mask, keys = np.uint64((1 << half) - 1), _mixed(np.arange(4, dtype=np.uint64) + np.uint64(4 * replicate) + _mixed(np.array([seed], np.uint64)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (_mixed(right + k) & mask)
        return (left << np.uint64(half)) | right

    x = once(places.astype(np.uint64))
    while (out := np.flatnonzero(x >= n)).size:
        x[out] = once(x[out])
    return x.astype(np.int64)


def moran_permutations(points: DataFrame, key: str, x: str, y: str, value: str, k: int = 8, permutations: int = 999, seed: int = 42) -> DataFrame:
    """n, moran, expected, geary, permutations and p (one-sided) of Moran's I: values permuted over a fixed table of the k nearest neighbours, weighted by inverse distance (rows sum to 1).

    Values are numbered and sent to every task, so there may be SENT of them at most; for more
    `estimates.spatial` gives the normal approximation.
    """
    base = points.dropna(subset=[key, x, y, value]).select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(value).cast("double").alias("v"))
    n = base.count()
    if n > SENT:
        raise ValueError(f"{n} values, more than {SENT}: permutations send them to every task")
    schema = "n long, moran double, expected double, geary double, permutations int, p double"
    if n < 3:
        return points.sparkSession.createDataFrame([(n, None, None, None, 0, None)], schema)
    placed = kept(slices.numbered(base, [], ["key"], ["v"]).select("key", "at", F.get("x", F.lit(0)).alias("v")))
    near = estimates.neighbours(base, "key", "x", "y", k).withColumn("w", 1 / F.greatest("distance", F.lit(1e-9)))
    near = near.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("key")))
    edges = near.join(placed.select("key", F.col("at").alias("i")), "key").join(placed.select(F.col("key").alias("other"), F.col("at").alias("j")), "other").select("i", "j", "w")
    told = placed.select("at", "v").toArrow()
    z = np.empty(n)
    z[told.column(0).to_numpy()] = told.column(1).to_numpy()
    z -= z.mean()
    sent = points.sparkSession.sparkContext.broadcast(z)

    def sums(frames):
        values = sent.value
        cross, total, apart = np.zeros(permutations + 1), 0.0, 0.0
        for f in frames:
            i, j, w = (f[c].to_numpy() for c in ("i", "j", "w"))
            total += w.sum()
            apart += (w * (values[i] - values[j]) ** 2).sum()
            cross[0] += (w * values[i] * values[j]).sum()
            for b in range(1, permutations + 1):
                cross[b] += (w * values[permuted(n, b, seed, i)] * values[permuted(n, b, seed, j)]).sum()
        yield pd.DataFrame({"b": np.arange(-2, permutations + 1), "s": np.concatenate(([total, apart], cross))})

    added = dict(map(tuple, kept(edges).mapInPandas(sums, "b int, s double").groupBy("b").agg(F.sum("s")).collect()))
    square = float((z**2).sum())
    if not square:
        return points.sparkSession.createDataFrame([(n, None, -1 / (n - 1), None, 0, None)], schema)
    i = n / added[-2] * np.array([added[b] for b in range(permutations + 1)]) / square
    p = (1 + int((i[1:] >= i[0] - 1e-12).sum())) / (permutations + 1)
    return points.sparkSession.createDataFrame([(n, float(i[0]), -1 / (n - 1), float((n - 1) * added[-1] / (2 * added[-2] * square)), permutations, p)], schema)
