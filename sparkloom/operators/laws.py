"""Laws as sums of basis terms: every candidate is a part of one matrix of cross-products.

All terms of all candidates are multiplied and summed in one pass; each candidate is then
solved from the sums and ranked by AIC. What comes to the driver is that matrix.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import slices


def _gram(rows: DataFrame, terms: list[Column]) -> tuple[int, np.ndarray]:
    k = len(terms)
    named = rows.select(*[t.cast("double").alias(f"t{i}") for i, t in enumerate(terms)])
    got = named.agg(F.count("*").alias("n"), *[F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    return got["n"], np.array([[got[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])


def _systems(states: list[str]) -> dict[str, list[list[tuple[int, tuple[str, ...], float]]]]:
    """Of each system its parameters; each is a list of the places where it stands: (state, product of states, sign)."""
    k, every = len(states), range(len(states))
    one = lambda i, *t: [(i, tuple(sorted(t, key=states.index)), 1.0)]
    out = {
        "linear": [one(i, *t) for i in every for t in [(), *[(s,) for s in states]]],
        "predation": [one(i, *t) for i in every for t in [(states[i],), *[(states[i], states[j]) for j in every if j != i]]],
        "competition": [one(i, *t) for i in every for t in [(states[i],), *[(states[i], states[j]) for j in every]]],
        "logistic": [one(i, *t) for i in every for t in [(states[i],), (states[i], states[i])]],
    }
    if k == 3:
        s, i, _ = states
        out["epidemic"] = [[(0, (s, i), -1.0), (1, (s, i), 1.0)], [(1, (i,), -1.0), (2, (i,), 1.0)]]
    return out


def coupled_systems(df: DataFrame, keys: list[str], order: list[str], states: list[str], step: float = 1.0, width: int = slices.WIDTH) -> DataFrame:
    """system, rank, n, aic, r2, and coefficients (term: value) of systems of two or more states that change by products of them: linear, predation (each grows by itself and by meetings), competition (and by its square), logistic (each by itself), epidemic (of three states: infection and recovery).

    Changes are central differences over rows `step` apart; a series is cut into slices. One
    system for all series of `keys`. Systems without rows enough are left out.
    """
    k = len(states)
    if k < 2:
        raise ValueError("a coupled system has two states at least")
    w = slices.windows(slices.numbered(df, keys, order, states), keys, 3, width)
    at = lambda place, i: F.get("w", F.lit(place * k + i))
    rows = w.select(*[at(1, i).alias(f"x{i}") for i in range(k)], *[((at(2, i) - at(0, i)) / (2 * step)).alias(f"d{i}") for i in range(k)])
    products = [(), *[(s,) for s in states], *combinations_with_replacement(states, 2)]

    def value(product: tuple[str, ...]) -> Column:
        out = F.lit(1.0)
        for s in product:
            out = out * F.col(f"x{states.index(s)}")
        return out

    n, g = _gram(rows, [*map(value, products), *[F.col(f"d{i}") for i in range(k)]])
    place = {p: i for i, p in enumerate(products)}
    total = [g[len(products) + i, len(products) + i] - g[0, len(products) + i] ** 2 / max(1, n) for i in range(k)]
    found = []
    for name, parameters in _systems(states).items():
        m = len(parameters)
        if n <= m:
            continue
        a, b = np.zeros((m, m)), np.zeros(m)
        for p, here in enumerate(parameters):
            for i, product, sign in here:
                b[p] += sign * g[place[product], len(products) + i]
                for q, there in enumerate(parameters):
                    a[p, q] += sum(sign * s2 * g[place[product], place[t2]] for j, t2, s2 in there if j == i)
        scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
        theta = np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=None)[0] / scale
        left = []
        for i in range(k):
            c = np.zeros(len(products) + k)
            c[len(products) + i] = 1.0
            for t, here in zip(theta, parameters, strict=True):
                for j, product, sign in here:
                    if j == i:
                        c[place[product]] -= sign * t
            left.append(max(float(c @ g @ c), 1e-14 * max(total[i], 1e-300)))
        aic = n * sum(math.log(r / n) for r in left) + 2 * m
        told = {" & ".join(f"d{states[i]}:{'*'.join(product) or '1'}" for i, product, _ in here): float(t) for t, here in zip(theta, parameters, strict=True)}
        found.append((name, aic, float(1 - sum(left) / sum(total)) if sum(total) > 0 else 0.0, told))
    found.sort(key=lambda r: r[1])
    return df.sparkSession.createDataFrame([(name, rank, n, aic, r2, told) for rank, (name, aic, r2, told) in enumerate(found, 1)], "system string, rank int, n long, aic double, r2 double, coefficients map<string,double>")


#: Of each closed form: the terms beside 1, whether the target is its logarithm, and whether x must be above 0.
FORMS: dict[str, tuple[tuple[str, ...], bool, bool]] = {
    "linear": (("x",), False, False),
    "quadratic": (("x", "x2"), False, False),
    "cubic": (("x", "x2", "x3"), False, False),
    "sine": (("sin", "cos"), False, False),
    "logarithmic": (("lnx",), False, True),
    "reciprocal": (("inv",), False, True),
    "root": (("root",), False, True),
    "power": (("lnx",), True, True),
    "exponential": (("x",), True, False),
}


def closed_forms(df: DataFrame, target: str, features: list[str], forms: tuple[str, ...] | None = None, pairs: bool = True) -> DataFrame:
    """feature, form, rank, n, aic, r2 (of the form's own target) and coefficients of closed forms of one feature, and of two: plane (a + b x + c z), product (a + b x z) and ratio (a + b x / z, where no z is 0).

    Forms that need values above 0 (of the feature, or of the target for power and
    exponential) are left out where there are others. AIC is that of the target itself, so
    forms of its logarithm compare with the rest. Complete rows count.
    """
    wanted = FORMS if forms is None else {f: FORMS[f] for f in forms}
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in (target, *features)]).dropna()
    ends = rows.agg(F.min(target).alias("ly"), *[F.min(c).alias(f"l_{c}") for c in features], *[F.max(F.abs(c)).alias(f"m_{c}") for c in features], *[F.min(F.abs(c)).alias(f"z_{c}") for c in features]).first()
    y = F.col(target)
    log_y = F.when(y > 0, F.log(y))
    terms: dict[str, Column] = {"1": F.lit(1.0), "y": y, "lny": log_y}
    for c in features:
        x = F.col(c)
        above = F.when(x > 0, x)
        unit = x * (2 * math.pi / (ends[f"m_{c}"] or 1.0))
        terms |= {f"x:{c}": x, f"x2:{c}": x**2, f"x3:{c}": x**3, f"sin:{c}": F.sin(unit), f"cos:{c}": F.cos(unit), f"lnx:{c}": F.log(above), f"inv:{c}": 1 / above, f"root:{c}": F.sqrt(above)}
    two = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]] if pairs else []
    for a, b in two:
        terms |= {f"product:{a}*{b}": F.col(a) * F.col(b), f"ratio:{a}/{b}": F.col(a) / F.nullif(F.col(b), F.lit(0.0))}
    names = list(terms)
    n, g = _gram(rows, list(terms.values()))
    found = []

    def fit(feature: str, form: str, used: list[str], logged: bool) -> None:
        if n <= len(used) + 2:
            return
        i, t = [0, *[names.index(u) for u in used]], names.index("lny" if logged else "y")
        a, b = g[np.ix_(i, i)], g[i, t]
        scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
        beta = np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=None)[0] / scale
        rss = float(g[t, t] - 2 * beta @ b + beta @ a @ beta)
        total = float(g[t, t] - g[0, t] ** 2 / n)
        rss = max(rss, 1e-13 * max(total, 1e-300))
        aic = n * math.log(rss / n) + 2 * (len(used) + 1) + (2 * float(g[0, names.index("lny")]) if logged else 0.0)
        found.append((feature, form, n, aic, 1 - rss / total if total > 0 else 0.0, [float(v) for v in beta]))

    for c in features if n else []:
        for form, (used, logged, above) in wanted.items():
            if (not above or ends[f"l_{c}"] > 0) and (not logged or ends["ly"] > 0):
                fit(c, form, [f"{u}:{c}" for u in used], logged)
    for a, b in two if n else []:
        fit(f"{a},{b}", "plane", [f"x:{a}", f"x:{b}"], False)
        fit(f"{a},{b}", "product", [f"product:{a}*{b}"], False)
        if ends[f"z_{b}"] > 0:
            fit(f"{a},{b}", "ratio", [f"ratio:{a}/{b}"], False)
    found.sort(key=lambda r: (r[3], r[0], r[1]))
    return df.sparkSession.createDataFrame([(c, form, rank, m, aic, r2, beta) for rank, (c, form, m, aic, r2, beta) in enumerate(found, 1)], "feature string, form string, rank int, n long, aic double, r2 double, coefficients array<double>")
