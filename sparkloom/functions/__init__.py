"""Scalar functions as columns: tails of distributions, similarity of vectors, sets and strings, bands of effect sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the Chebyshev fit of erfc (relative error under 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """The complementary error function."""
    z = F.abs(x)
    t = 1 / (1 + 0.5 * z)
    series = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        series = series * t + c
    tail = t * F.exp(-z * z + series)
    return F.when(x >= 0, tail).otherwise(2 - tail)


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the standard normal distribution."""
    return erfc(F.abs(z) / math.sqrt(2))


def chi2_tail(x: Column, df: int) -> Column:
    """Upper tail of chi-square with one or an even number of degrees of freedom."""
    if df == 1:
        return erfc(F.sqrt(x / 2))
    term, total = F.lit(1.0), F.lit(1.0)
    for i in range(1, df // 2):
        term = term * (x / 2) / i
        total = total + term
    return F.exp(-x / 2) * total


def erfc_sql(x: str) -> str:
    """erfc in SQL, for the checks."""
    series = str(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        series = f"(({series}) * (1 / (1 + 0.5 * abs({x}))) + ({c}))"
    tail = f"((1 / (1 + 0.5 * abs({x}))) * exp(-({x}) * ({x}) + {series}))"
    return f"(CASE WHEN {x} >= 0 THEN {tail} ELSE 2 - {tail} END)"


def normal_quantile(p: float) -> float:
    """The point below which a standard normal value lies with probability p."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 where one has no length."""
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x))


def tokens(text: Column) -> Column:
    """Distinct runs of a-z, 0-9 and underscores of the text in small letters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets given as arrays; 0 where one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def edit_ratio(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer text's length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(1.0)


def token_sort(text: Column) -> Column:
    """The text's words in small letters, sorted, joined by one space."""
    return F.array_join(F.sort_array(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")), " ")


def slug(text: Column, size: int = 80) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), F.lit("_")), 1, size)


def cohens_d_band(d: Column) -> Column:
    x = F.abs(d)
    return F.when(x.isNull(), "insufficient_data").when(x < 0.2, "negligible").when(x < 0.5, "small").when(x < 0.8, "medium").when(x < 1.2, "large").otherwise("very_large")


def eta_squared_band(e: Column) -> Column:
    return F.when(e.isNull(), "insufficient_data").when(e < 0.01, "negligible").when(e < 0.06, "small").when(e < 0.14, "medium").otherwise("large")


def odds_ratio_band(r: Column) -> Column:
    x = F.greatest(r, 1 / r)
    return F.when(r.isNull() | (r <= 0), "insufficient_data").when(x < 1.5, "negligible").when(x < 3.5, "small").when(x < 9.0, "medium").otherwise("large")


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.7, "high").when(c >= 0.4, "medium").otherwise("low")
