"""A covariance that outliers can't mask: concentration steps on half of the rows, by passes of counts and sums.

A step measures every row's distance from the present centre, keeps the h rows of least
distance, and takes their mean and covariance. The h-th distance is found by counting rows in
bins of the distance's logarithm, twice: nothing is sorted, and what comes to the driver is
the counts and a matrix of columns by columns. Steps end when the determinant falls no more.
Starts are medians with median deviations, and samples by a hash; the start of least
determinant after two steps goes on. In the end the rows within the chi-square point of 0.975
give the centre and the covariance.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.lineage import kept

BINS, LOW, HIGH = 2048, -80.0, 80.0


def chi2_below(x: float, df: float) -> float:
    """The chance that a chi-square value of `df` degrees of freedom lies below x."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return total * scale
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        b += 2
        d = 1 / (b - i * (i - a) * d)
        c = b - i * (i - a) / c
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return 1 - scale * h


def chi2_point(p: float, df: float) -> float:
    """The point below which a chi-square value lies with probability p."""
    lo, hi = 0.0, df + 10 * math.sqrt(2 * df) + 60
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_below(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def _distance(columns: list[str], centre: np.ndarray, inverse: np.ndarray):
    dev = [F.col(c) - float(m) for c, m in zip(columns, centre, strict=True)]
    total = F.lit(0.0)
    for i in range(len(columns)):
        for j in range(i, len(columns)):
            total = total + dev[i] * dev[j] * float(inverse[i, j] * (1 if i == j else 2))
    return F.when(total < 0, 0.0).otherwise(total)


def _cut(far: DataFrame, h: int) -> float:
    """A value at or a little above the h-th least `d`: counted in bins of its logarithm, then in parts of the bin."""
    place = F.least(F.lit(HIGH), F.greatest(F.lit(LOW), F.log2(F.greatest("d", F.lit(1e-300)))))
    lo, hi, before = LOW, HIGH, 0
    for _ in range(2):
        width = (hi - lo) / BINS
        bin_ = F.least(F.lit(BINS - 1), F.floor((F.col("p") - lo) / width)).cast("int")
        counts = far.select(place.alias("p")).where((F.col("p") >= lo) & (F.col("p") <= hi)).groupBy(bin_.alias("b")).count().collect()
        n = before
        for r in sorted(counts, key=lambda r: r["b"]):
            if n + r["count"] >= h:
                break
            n += r["count"]
        lo, hi, before = lo + r["b"] * width, lo + (r["b"] + 1) * width, n
    return 2.0**hi


def _moments(rows: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    k = len(columns)
    got = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    if not got["n"]:
        return 0, np.zeros(k), np.eye(k)
    return got["n"], np.array([got[f"m{i}"] for i in range(k)]), np.array([[got[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])


def _inverse(cov: np.ndarray) -> np.ndarray:
    ridge = 1e-12 * max(1e-300, np.trace(cov) / len(cov))
    return np.linalg.pinv(cov + ridge * np.eye(len(cov)))


def _step(rows: DataFrame, columns: list[str], centre: np.ndarray, cov: np.ndarray, h: int) -> tuple[float, np.ndarray, np.ndarray]:
    far = rows.select(*columns, _distance(columns, centre, _inverse(cov)).alias("d"))
    _, centre, cov = _moments(far.where(F.col("d") <= _cut(far, h)), columns)
    sign, logdet = np.linalg.slogdet(cov)
    return (logdet if sign > 0 else -math.inf), centre, cov


def covariance(df: DataFrame, columns: list[str], share: float | None = None, starts: int = 2, steps: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Centre, covariance (made consistent for normal rows), n and h, of the complete rows' h of least determinant (share of them; by default a little over half)."""
    rows = kept(df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna())
    n, k = rows.count(), len(columns)
    h = n if n <= 2 * k else min(n, max((n + k + 1) // 2, math.ceil((share or 0) * n)))
    if h == n:
        _, centre, cov = _moments(rows, columns)
        return centre, cov, n, n
    medians = rows.agg(*[F.percentile_approx(c, 0.5, 10_000).alias(c) for c in columns]).first()
    spread = rows.agg(*[F.percentile_approx(F.abs(F.col(c) - float(medians[c])), 0.5, 10_000).alias(c) for c in columns]).first()
    begin = [(np.array([medians[c] for c in columns], float), np.diag([max(1.4826 * (spread[c] or 0.0), 1e-9) ** 2 for c in columns]))]
    for s in range(starts):
        some = rows.where(F.pmod(F.xxhash64(*columns, F.lit(seed + s)), F.lit(1_000_000)) < math.ceil(1_000_000 * min(1.0, 20 * k / n)))
        m, centre, cov = _moments(some, columns)
        if m > k:
            begin.append((centre, cov))
    after = []
    for centre, cov in begin:
        for _ in range(2):
            logdet, centre, cov = _step(rows, columns, centre, cov, h)
        after.append((logdet, len(after), centre, cov))
    logdet, _, centre, cov = min(after, key=lambda a: a[:2])
    for _ in range(steps):
        told = _step(rows, columns, centre, cov, h)
        if not told[0] < logdet - 1e-10:
            break
        logdet, centre, cov = told
    cov = cov * (h / n) / chi2_below(chi2_point(h / n, k), k + 2)
    # once more on all rows that lie near, as half of the rows tell little of clean ones
    q = chi2_point(0.975, k)
    m, near, wide = _moments(rows.where(_distance(columns, centre, _inverse(cov)) <= q), columns)
    return (near, wide * 0.975 / chi2_below(q, k + 2), n, h) if m > 2 * k else (centre, cov, n, h)


def robust_outliers(df: DataFrame, columns: list[str], p: float = 0.975, **options) -> DataFrame:
    """The rows with `distance` (squared, from the robust centre) and `outlier`: whether it is beyond the chi-square point; null for rows with a null in `columns`."""
    centre, cov, _, _ = covariance(df, columns, **options)
    d = _distance(columns, centre, _inverse(cov))
    return df.withColumn("distance", d).withColumn("outlier", F.col("distance") > chi2_point(p, len(columns)))
