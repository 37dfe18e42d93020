"""Statistics from sums: everything here is one or two aggregations, whatever the number of rows."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r of every pair of columns, from one pass."""
    parts = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in combinations(columns, 2)]
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def ranks(df: DataFrame, column: str, key: str) -> DataFrame:
    """key and rank (ties get their mean) of the filled rows, without one task that sorts all of them.

    Values are counted first; the running sum of those counts is taken within ranges
    of values, and the ranges' totals are few.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count("*").alias("n"))
    bounds = [float(b) for b in counts.approxQuantile("x", [i / 32 for i in range(1, 32)], 0.01)]
    part = sum(((F.col("x") > b).cast("int") for b in bounds), F.lit(0)) if bounds else F.lit(0)
    counts = counts.withColumn("part", part)
    totals = counts.groupBy("part").agg(F.sum("n").alias("t"))
    before = totals.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("x"))
    ranked = counts.withColumn("upto", inside).join(F.broadcast(before), "part").select("x", (F.col("before") + F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))
    return df.join(ranked, df[column] == ranked["x"]).select(key, "rank")


def spearman(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = ranks(rows, a, key).withColumnRenamed("rank", "ra").join(ranks(rows, b, key).withColumnRenamed("rank", "rb"), key)
    return both.agg(F.corr("ra", "rb").alias("rho"))


def robust_z(df: DataFrame, column: str, groups: list[str], least: int = 10) -> DataFrame:
    """z = 0.6745 * (x - median) / MAD within groups; null where the MAD is 0 or a group is small."""
    x = F.col(column)
    middle = df.groupBy(*groups).agg(F.median(column).alias("_m"), F.count(column).alias("_n"))
    away = df.join(middle, groups).withColumn("_d", F.abs(x - F.col("_m")))
    mad = away.groupBy(*groups).agg(F.median("_d").alias("_mad"))
    z = F.when((F.col("_mad") > 0) & (F.col("_n") >= least), 0.6745 * (x - F.col("_m")) / F.col("_mad"))
    return away.join(mad, groups).withColumn("z", z).drop("_m", "_n", "_d", "_mad")


def cohens_d(df: DataFrame, value: str, treated: Column) -> DataFrame:
    """n_a, n_b, d (pooled standard deviation) of the treated against the rest."""
    found = df.agg(*[f(F.when(t, F.col(value))).alias(f"{n}_{s}") for t, s in ((treated, "a"), (~treated, "b")) for f, n in ((F.count, "n"), (F.avg, "m"), (F.var_samp, "v"))])
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b")) / (F.col("n_a") + F.col("n_b") - 2))
    return found.select("n_a", "n_b", ((F.col("m_a") - F.col("m_b")) / pooled).alias("d"))


def eta_squared(df: DataFrame, value: str, group: str) -> DataFrame:
    """Share of the sum of squares that lies between groups."""
    each = df.groupBy(group).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    whole = each.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    mean = F.col("s") * F.col("s") / F.col("n")
    return whole.select("n", ((F.col("b") - mean) / (F.col("q") - mean)).alias("eta_squared"))


def odds_ratio(df: DataFrame, exposed: Column, outcome: Column) -> DataFrame:
    """Of a 2 x 2 table with half a case added to each cell, and the 95 % interval."""
    c = df.agg(*[F.count_if(e & o).cast("double").alias(n) for n, e, o in (("a", exposed, outcome), ("b", exposed, ~outcome), ("c", ~exposed, outcome), ("d", ~exposed, ~outcome))])
    a, b, cc, d = (F.col(n) + 0.5 for n in "abcd")
    log, se = F.log(a * d / (b * cc)), F.sqrt(1 / a + 1 / b + 1 / cc + 1 / d)
    return c.select(F.exp(log).alias("ratio"), F.exp(log - 1.959963984540054 * se).alias("low"), F.exp(log + 1.959963984540054 * se).alias("high"))


def kaplan_meier(df: DataFrame, duration: str, event: Column, groups: list[str]) -> DataFrame:
    """time, at_risk, deaths and survival of each group at its times of death."""
    times = df.groupBy(*groups, F.col(duration).alias("time")).agg(F.count("*").alias("n"), F.count_if(event).alias("deaths"))
    later = Window.partitionBy(*groups).orderBy(F.desc("time"))
    earlier = Window.partitionBy(*groups).orderBy("time")
    risk = times.withColumn("at_risk", F.sum("n").over(later)).where("deaths > 0")
    logs = F.sum(F.when(F.col("deaths") < F.col("at_risk"), F.log(1 - F.col("deaths") / F.col("at_risk")))).over(earlier)
    none = F.max((F.col("deaths") == F.col("at_risk")).cast("int")).over(earlier)
    return risk.select(*groups, "time", "at_risk", "deaths", F.when(none == 1, 0.0).otherwise(F.exp(F.coalesce(logs, F.lit(0.0)))).alias("survival"))


def log_rank(df: DataFrame, duration: str, event: Column, arm: Column) -> DataFrame:
    """Mantel's chi-square with one degree of freedom of two arms."""
    times = df.groupBy(F.col(duration).alias("time")).agg(F.count("*").alias("n"), F.count_if(arm).alias("na"), F.count_if(event).alias("d"), F.count_if(event & arm).alias("da"))
    later = Window.orderBy(F.desc("time"))
    risk = times.select("d", "da", F.sum("n").over(later).alias("r"), F.sum("na").over(later).alias("ra")).where("d > 0")
    expected = F.col("d") * F.col("ra") / F.col("r")
    variance = F.when(F.col("r") > 1, expected * (1 - F.col("ra") / F.col("r")) * (F.col("r") - F.col("d")) / (F.col("r") - 1)).otherwise(0.0)
    return risk.agg(F.sum(F.col("da") - expected).alias("o"), F.sum(variance).alias("v")).select((F.col("o") * F.col("o") / F.col("v")).alias("chi2"))


def mutual_information(df: DataFrame, a: str, b: str, bins: int = 10) -> DataFrame:
    """In nats, of two columns in equal-width bins."""
    lo = df.agg(*[f(c).cast("double").alias(f"{n}{i}") for i, c in enumerate((a, b)) for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    cell = lambda c, i: F.least(F.lit(bins - 1), F.floor((F.col(c) - lo[f"lo{i}"]) / ((lo[f"hi{i}"] - lo[f"lo{i}"]) or 1.0) * bins)).cast("int")
    joint = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(cell(a, 0).alias("i"), cell(b, 1).alias("j")).agg(F.count("*").alias("n"))
    row, column, whole = (F.sum("n").over(Window.partitionBy(*k)) for k in (["i"], ["j"], []))
    return joint.select((F.col("n") / whole * F.log(F.col("n") * whole / (row * column))).alias("t")).agg(F.sum("t").alias("mi"))


def linear_regression(df: DataFrame, target: str, features: list[str]) -> dict[str, float]:
    """Coefficients, intercept and r2 by normal equations: one pass over the rows, a small system on the driver."""
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(target).cast("double")]
    rows = df.dropna(subset=[*features, target])
    sums = rows.agg(*[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]).first()
    m = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(x))] for i in range(len(x))], float)
    beta = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]
    total = m[-1, -1] - m[0, -1] ** 2 / max(m[0, 0], 1.0)
    rss = m[-1, -1] - 2 * beta @ m[:-1, -1] + beta @ m[:-1, :-1] @ beta
    return {"intercept": float(beta[0]), **{f: float(b) for f, b in zip(features, beta[1:], strict=True)}, "r2": float(1 - rss / total) if total else 0.0}


def mahalanobis(df: DataFrame, columns: list[str], ridge: float = 1e-6) -> DataFrame:
    """The rows with their distance; the covariance is one aggregation, its inverse a small matrix on the driver."""
    found = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]).first()
    cov = np.array([[found[f"c{min(i, j)}_{max(i, j)}"] for j in range(len(columns))] for i in range(len(columns))], float)
    inverse = np.linalg.inv(cov + ridge * np.eye(len(columns)))
    away = [F.col(c) - found[f"m{i}"] for i, c in enumerate(columns)]
    square = sum(away[i] * away[j] * float(inverse[i, j]) for i in range(len(columns)) for j in range(len(columns)))
    return df.withColumn("distance", F.sqrt(square))
