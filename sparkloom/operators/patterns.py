"""Kernels that walk a series: change points, regimes, smoothing, motifs, warping, decompositions.

Each runs inside Arrow tasks, one bounded series at a time; `series.representative`-like
thinning or daily buckets come before, where a series is long. Spark deals the series out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that one series may have in a kernel of quadratic cost.
LONGEST = 20_000


def each_series(df: DataFrame, keys: list[str], order: list[str], values: list[str], kernel: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """kernel(x, ...) of each series' values in order, its rows with the keys before them; a series of more than LONGEST values fails and says so."""
    told = ", ".join(f"{k} {t}" for k, t in df.dtypes if k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > LONGEST:
            raise ValueError(f"a series has {len(pdf)} values, more than {LONGEST}: bucket or thin it first, or cut it by operators.slices")
        pdf = pdf.sort_values(order)
        out = kernel(*[pdf[v].to_numpy(float) for v in values])
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    rows = df.select(*keys, *order, *[v for v in values if v not in order]).dropna(subset=values)
    return rows.groupBy(*keys).applyInPandas(run, f"{told}, {schema}")


def cusum_points(x: np.ndarray, slack: float = 0.5, limit: float = 8.0, apart: int = 30, most: int = 25) -> pd.DataFrame:
    """at, side of two-sided CUSUM alarms, at least `apart` from one another, the first `most`."""
    sd, mean, up, down, out = x.std() or 1.0, x[: max(10, len(x) // 10)].mean(), 0.0, 0.0, []
    for i, v in enumerate(x):
        z = (v - mean) / sd
        up, down = max(0.0, up + z - slack), max(0.0, down - z - slack)
        if max(up, down) > limit:
            if not out or i - out[-1][0] >= apart:
                out.append((i, 1 if up > down else -1))
            mean, up, down = x[max(0, i - 80) : i + 1].mean(), 0.0, 0.0
    return pd.DataFrame(out[:most], columns=["at", "side"]).astype("int64")


def pelt_points(x: np.ndarray, penalty: float | None = None, least: int = 2) -> pd.DataFrame:
    """start, length, mean and sd of the segments that minimise squared error plus a penalty for each (pruned exact search)."""
    n = len(x)
    z = (x - x.mean()) / (x.std() or 1.0)
    s, q = np.concatenate(([0.0], np.cumsum(z))), np.concatenate(([0.0], np.cumsum(z * z)))
    beta = 3 * np.log(max(2, n)) if penalty is None else penalty
    best, last, alive = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.array([0])
    best[0] = -beta
    for t in range(least, n + 1):
        ready = alive[t - alive >= least]
        cost = q[t] - q[ready] - (s[t] - s[ready]) ** 2 / (t - ready)
        total = best[ready] + cost + beta
        k = total.argmin()
        best[t], last[t] = total[k], ready[k]
        alive = np.concatenate((ready[best[ready] + cost <= best[t]], alive[t - alive < least], [t]))
    cuts = [n]
    while cuts[-1] > 0:
        cuts.append(last[cuts[-1]])
    cuts = cuts[::-1]
    return pd.DataFrame([(a, b - a, x[a:b].mean(), x[a:b].std()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], columns=["start", "length", "mean", "sd"]).astype({"start": "int64", "length": "int64"})


def bayes_points(x: np.ndarray, hazard: float = 1 / 50, longest: int = 300) -> pd.DataFrame:
    """at and probability that a run has just begun, by online Bayesian detection with a normal-inverse-gamma model."""
    from math import lgamma

    z = (x - x.mean()) / (x.std() or 1.0)
    mu, kappa, alpha, beta, p, out = np.zeros(1), np.ones(1), np.ones(1), np.ones(1), np.ones(1), []
    for v in z:
        scale = beta * (kappa + 1) / (alpha * kappa)
        log = np.array([lgamma(a + 0.5) - lgamma(a) for a in alpha]) - 0.5 * np.log(2 * np.pi * alpha * scale) - (alpha + 0.5) * np.log1p((v - mu) ** 2 / (2 * alpha * scale))
        like = np.exp(log)
        grown, fresh = p * like * (1 - hazard), (p * like * hazard).sum()
        p = np.concatenate(([fresh], grown))[:longest]
        p /= p.sum() or 1.0
        mu, beta = np.concatenate(([0.0], (kappa * mu + v) / (kappa + 1)))[:longest], np.concatenate(([1.0], beta + kappa * (v - mu) ** 2 / (2 * (kappa + 1))))[:longest]
        kappa, alpha = np.concatenate(([1.0], kappa + 1))[:longest], np.concatenate(([1.0], alpha + 0.5))[:longest]
        out.append(p[: min(5, len(p))].sum())
    out[: min(10, len(out))] = [0.0] * min(10, len(out))
    return pd.DataFrame({"at": np.arange(len(x)), "probability": out})


def smoothed(x: np.ndarray, q: float = 0.3, r: float = 0.7, horizon: int = 12) -> pd.DataFrame:
    """at, level, low and high of a local-level smoother, and of the next `horizon` steps."""
    s2 = x.var() or 1.0
    level, p, levels, before, after = x[0], s2, [], [], []
    for v in x:
        p += q * s2
        before.append(p)
        gain = p / (p + r * s2)
        level, p = level + gain * (v - level), (1 - gain) * p
        levels.append(level)
        after.append(p)
    smooth, var = levels[:], after[:]
    for i in range(len(x) - 2, -1, -1):
        g = after[i] / before[i + 1]
        smooth[i] = levels[i] + g * (smooth[i + 1] - levels[i])
        var[i] = after[i] + g * g * (var[i + 1] - before[i + 1])
    smooth += [level] * horizon
    var += [p + (h + 1) * q * s2 for h in range(horizon)]
    half = 1.959963984540054 * np.sqrt(var)
    return pd.DataFrame({"at": np.arange(len(smooth)), "level": smooth, "low": smooth - half, "high": smooth + half})


def motifs(x: np.ndarray, window: int | None = None, most: int = 3) -> pd.DataFrame:
    """kind (motif or discord), at, other and distance: the nearest pairs of windows and the windows furthest from all others, none overlapping."""
    m = window or int(np.clip(len(x) // 20, 10, 200))
    n = len(x) - m + 1
    if n < 2 * m:
        return pd.DataFrame({"kind": [], "at": [], "other": [], "distance": []}).astype({"at": "int64", "other": "int64", "distance": float})
    w = np.lib.stride_tricks.sliding_window_view(x, m)
    sd = w.std(axis=1, keepdims=True)
    z = (w - w.mean(axis=1, keepdims=True)) / np.where(sd > 1e-12, sd, 1.0)
    dist, near = np.empty(n), np.empty(n, int)
    for a in range(0, n, 256):
        d = np.maximum(0, 2 * m - 2 * z[a : a + 256] @ z.T)
        i = np.arange(a, min(a + 256, n))
        d[np.abs(i[:, None] - np.arange(n)[None]) < max(1, m // 2)] = np.inf
        near[i], dist[i] = d.argmin(axis=1), np.sqrt(d.min(axis=1))
    rows = []
    for kind, order in (("motif", np.argsort(dist, kind="stable")), ("discord", np.argsort(-dist, kind="stable"))):
        taken: list[int] = []
        for i in order:
            spots = (i, near[i]) if kind == "motif" else (i,)
            if len([r for r in rows if r[0] == kind]) < most and all(abs(s - t) >= m for s in spots for t in taken):
                rows.append((kind, int(i), int(near[i]), float(dist[i])))
                taken += spots
    return pd.DataFrame(rows, columns=["kind", "at", "other", "distance"])


def hop_entropy(x: np.ndarray, window: int = 64) -> pd.DataFrame:
    """at, entropy and jump of the normalised power spectrum in windows that hop by half their length."""
    out = []
    for a in range(0, max(1, len(x) - window + 1), max(1, window // 2)):
        part = x[a : a + window]
        p = np.abs(np.fft.rfft(part - part.mean()))[1:] ** 2
        p = p[p > 0] / p.sum() if p.sum() > 0 else np.ones(1)
        out.append((a, float(-(p * np.log(p)).sum() / np.log(max(2, window // 2)))))
    e = np.array([v for _, v in out])
    return pd.DataFrame({"at": [a for a, _ in out], "entropy": e, "jump": np.abs(np.diff(e, prepend=e[0]))})


def warped(x: np.ndarray, y: np.ndarray, band: float = 0.1) -> pd.DataFrame:
    """distance (root of the summed squares along the best banded path) and bound (Keogh's lower bound) of two z-normalised series."""
    x, y = ((v - v.mean()) / (v.std() or 1.0) for v in (x, y))
    n = len(x)
    r = max(1, int(band * n))
    row = np.full(n + 1, np.inf)
    row[0] = 0.0
    for i in range(n):
        fresh = np.full(n + 1, np.inf)
        for j in range(max(0, i - r), min(n, i + r + 1)):
            fresh[j + 1] = (x[i] - y[j]) ** 2 + min(row[j], row[j + 1], fresh[j])
        row = fresh
    low, high = (np.array([f(y[max(0, i - r) : i + r + 1]) for i in range(n)]) for f in (np.min, np.max))
    bound = np.sqrt((np.maximum(0, np.maximum(low - x, x - high)) ** 2).sum())
    return pd.DataFrame({"distance": [float(np.sqrt(row[n]))], "bound": [float(bound)]})


def seasonal_parts(x: np.ndarray, period: int = 7) -> pd.DataFrame:
    """at, trend, season and rest: a centred running mean over a period, the mean of each phase, what is left."""
    n = len(x)
    weights = np.ones(period) / period if period % 2 else np.concatenate(([0.5], np.ones(period - 1), [0.5])) / period
    half = len(weights) // 2
    padded = np.pad(x, half, mode="edge")
    trend = np.convolve(padded, weights, mode="valid")[:n]
    phase = np.arange(n) % period
    season = np.array([(x - trend)[phase == k].mean() if (phase == k).any() else 0.0 for k in range(period)])
    season -= season.mean()
    return pd.DataFrame({"at": np.arange(n), "trend": trend, "season": season[phase], "rest": x - trend - season[phase]})


def intrinsic_modes(x: np.ndarray, most: int = 5, limit: float = 0.3, sifts: int = 50) -> pd.DataFrame:
    """mode, at and value: modes sifted out one after another between envelopes through the extremes (natural cubic splines)."""

    def spline(at: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
        if len(at) < 3:
            return np.interp(np.arange(n), at, v)
        h = np.diff(at)
        a = np.zeros((len(at), len(at)))
        b = np.zeros(len(at))
        a[0, 0] = a[-1, -1] = 1
        for i in range(1, len(at) - 1):
            a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            b[i] = 6 * ((v[i + 1] - v[i]) / h[i] - (v[i] - v[i - 1]) / h[i - 1])
        m = np.linalg.solve(a, b)
        t = np.arange(n)
        k = np.clip(np.searchsorted(at, t, "right") - 1, 0, len(h) - 1)
        d, e = t - at[k], at[k + 1] - t
        return (m[k] * e**3 + m[k + 1] * d**3) / (6 * h[k]) + (v[k] / h[k] - m[k] * h[k] / 6) * e + (v[k + 1] / h[k] - m[k + 1] * h[k] / 6) * d

    rest, rows, n = x.astype(float), [], len(x)
    for mode in range(1, most + 1):
        h = rest.copy()
        for _ in range(sifts):
            top = np.flatnonzero((h[1:-1] > h[:-2]) & (h[1:-1] >= h[2:])) + 1
            low = np.flatnonzero((h[1:-1] < h[:-2]) & (h[1:-1] <= h[2:])) + 1
            if len(top) < 2 or len(low) < 2:
                break
            ends = [np.concatenate(([0], p, [n - 1])) for p in (top, low)]
            middle = (spline(ends[0], h[ends[0]], n) + spline(ends[1], h[ends[1]], n)) / 2
            change = (middle**2).sum() / max(1e-12, (h**2).sum())
            h = h - middle
            if change < limit**2:
                break
        if np.allclose(h, rest):
            break
        rows.append(pd.DataFrame({"mode": mode, "at": np.arange(n), "value": h}))
        rest = rest - h
    rows.append(pd.DataFrame({"mode": 0, "at": np.arange(n), "value": rest}))
    return pd.concat(rows)


def hidden_regimes(x: np.ndarray, states: tuple[int, ...] = (2, 3, 4), rounds: int = 50) -> pd.DataFrame:
    """at, regime (by rising mean) and states: a Gaussian hidden Markov model, the number of states by BIC."""
    best = None
    for k in states:
        mu, var = np.quantile(x, (np.arange(k) + 0.5) / k), np.full(k, x.var() / k + 1e-9)
        trans, start = np.full((k, k), 0.1 / max(1, k - 1)), np.full(k, 1 / k)
        np.fill_diagonal(trans, 0.9)
        for _ in range(rounds):
            e = np.exp(-0.5 * (x[:, None] - mu) ** 2 / var) / np.sqrt(2 * np.pi * var) + 1e-300
            a, c = np.empty((len(x), k)), np.empty(len(x))
            for t in range(len(x)):
                a[t] = (start if t == 0 else a[t - 1] @ trans) * e[t]
                c[t] = a[t].sum()
                a[t] /= c[t]
            b = np.ones((len(x), k))
            for t in range(len(x) - 2, -1, -1):
                b[t] = trans @ (e[t + 1] * b[t + 1]) / c[t + 1]
            g = a * b
            g /= g.sum(axis=1, keepdims=True)
            pair = trans * ((a[:-1] / c[1:, None]).T @ (e[1:] * b[1:]))
            trans, start = pair / pair.sum(axis=1, keepdims=True), g[0]
            w = g.sum(axis=0)
            mu = (g * x[:, None]).sum(axis=0) / w
            var = (g * (x[:, None] - mu) ** 2).sum(axis=0) / w + 1e-6 * (x.var() + 1e-9)
        bic = -2 * np.log(c).sum() + (k * k + 2 * k - 1) * np.log(len(x))
        if best is None or bic < best[0]:
            rank = np.argsort(np.argsort(mu))
            best = (bic, rank[g.argmax(axis=1)], k)
    return pd.DataFrame({"at": np.arange(len(x)), "regime": best[1].astype("int64"), "states": best[2]})


def ridge_of_waves(x: np.ndarray, scales: int = 16) -> pd.DataFrame:
    """at, period and power of the strongest Morlet wave at each place."""
    n, w0 = len(x), 6.0
    f = np.fft.fft(x - x.mean())
    omega = 2 * np.pi * np.fft.fftfreq(n)
    periods = np.geomspace(2, max(3, n / 2), scales)
    power = []
    for p in periods:
        s = p * (w0 + np.sqrt(2 + w0**2)) / (4 * np.pi)
        wave = np.where(omega > 0, np.pi**-0.25 * np.exp(-0.5 * (s * omega - w0) ** 2), 0) * np.sqrt(2 * np.pi * s)
        power.append(np.abs(np.fft.ifft(f * wave)) ** 2)
    power = np.array(power)
    top = power.argmax(axis=0)
    return pd.DataFrame({"at": np.arange(n), "period": periods[top], "power": power[top, np.arange(n)]})


def analog_forecast(x: np.ndarray, window: int = 10, k: int = 5, horizon: int = 5) -> pd.DataFrame:
    """h, value, low and high: what followed the k windows most like the last one, rescaled to it."""
    n = len(x) - window - horizon
    if n < k:
        return pd.DataFrame({"h": [], "value": [], "low": [], "high": []}).astype({"h": "int64", "value": float, "low": float, "high": float})
    w = np.lib.stride_tricks.sliding_window_view(x, window)[: n + 1]
    last = x[-window:]
    norm = lambda v: (v - v.mean(axis=-1, keepdims=True)) / np.maximum(1e-12, v.std(axis=-1, keepdims=True))
    near = np.argsort(((norm(w) - norm(last)) ** 2).sum(axis=1), kind="stable")[:k]
    futures = np.array([(x[i + window : i + window + horizon] - w[i].mean()) / max(1e-12, w[i].std()) * last.std() + last.mean() for i in near])
    half = 1.959963984540054 * futures.std(axis=0)
    return pd.DataFrame({"h": np.arange(1, horizon + 1), "value": futures.mean(axis=0), "low": futures.mean(axis=0) - half, "high": futures.mean(axis=0) + half})


def simulated_bands(x: np.ndarray, paths: int = 2000, horizon: int = 24, seed: int = 7) -> pd.DataFrame:
    """h, p05, p50, p95 of simulated AR(1) paths."""
    m, rng = x.mean(), np.random.default_rng(seed)
    phi = float(np.clip(np.cov(x[1:], x[:-1], bias=True)[0, 1] / (x[:-1].var() or 1.0), -0.999, 0.999))
    sd = (x[1:] - m - phi * (x[:-1] - m)).std()
    v, out = np.full(paths, x[-1]), []
    for h in range(1, horizon + 1):
        v = m + phi * (v - m) + rng.normal(0, sd, paths)
        out.append((h, *np.quantile(v, (0.05, 0.5, 0.95))))
    return pd.DataFrame(out, columns=["h", "p05", "p50", "p95"])


def ar3_residuals(x: np.ndarray, limit: float = 2.5) -> pd.DataFrame:
    """at and z of values whose AR(3) residual lies `limit` deviations out."""
    a = np.column_stack([np.ones(len(x) - 3), x[2:-1], x[1:-2], x[:-3]])
    r = x[3:] - a @ np.linalg.lstsq(a, x[3:], rcond=None)[0]
    z = (r - r.mean()) / (r.std() or 1.0)
    at = np.flatnonzero(np.abs(z) >= limit)
    return pd.DataFrame({"at": at + 3, "z": z[at]})


def physics_forms(t: np.ndarray, y: np.ndarray) -> pd.DataFrame:
    """form, rmse and aic of laws fitted by least squares: linear, quadratic, exponential, power, logistic growth, linear relaxation."""
    out = []
    t0, n = t - t.min() + 1.0, len(y)
    tried = {"linear": np.column_stack([np.ones(n), t0]), "quadratic": np.column_stack([np.ones(n), t0, t0**2])}
    for name, a in tried.items():
        out.append((name, y - a @ np.linalg.lstsq(a, y, rcond=None)[0], a.shape[1]))
    if (y > 0).all():
        for name, x in (("exponential", t0), ("power", np.log(t0))):
            a = np.column_stack([np.ones(n), x])
            out.append((name, y - np.exp(a @ np.linalg.lstsq(a, np.log(y), rcond=None)[0]), 2))
    dt = np.diff(t)
    slope = np.diff(y) / np.where(dt > 0, dt, 1.0)
    for name, a in (("relaxation", np.column_stack([np.ones(n - 1), y[:-1]])), ("logistic", np.column_stack([y[:-1], y[:-1] ** 2]))):
        c = np.linalg.lstsq(a, slope, rcond=None)[0]
        walk = np.empty(n)
        walk[0] = y[0]
        with np.errstate(over="ignore", invalid="ignore"):
            for i in range(n - 1):
                v = walk[i]
                walk[i + 1] = v + dt[i] * (c[0] + c[1] * v if name == "relaxation" else c[0] * v + c[1] * v * v)
        if np.isfinite(walk).all():
            out.append((name, y - walk, 2))
    rows = [(name, float(np.sqrt((r**2).mean())), float(n * np.log(max(1e-300, (r**2).mean())) + 2 * k)) for name, r, k in out]
    return pd.DataFrame(rows, columns=["form", "rmse", "aic"]).sort_values("aic")


def nearest_information(x: np.ndarray, y: np.ndarray, k: int = 3) -> pd.DataFrame:
    """mi: mutual information in nats by the k nearest neighbours' estimate."""
    n = len(x)
    digamma = np.concatenate(([0.0], np.cumsum(1 / np.arange(1, n + 1)))) - 0.5772156649015329  # digamma(m + 1)
    x, y = ((v - v.mean()) / (v.std() or 1.0) for v in (x, y))
    total = 0.0
    for a in range(0, n, 256):
        dx, dy = np.abs(x[a : a + 256, None] - x), np.abs(y[a : a + 256, None] - y)
        both = np.maximum(dx, dy)
        both[np.arange(len(both)), a + np.arange(len(both))] = np.inf
        edge = np.partition(both, k - 1, axis=1)[:, k - 1][:, None]
        total += sum(digamma[(d < edge).sum(axis=1) - 1].sum() for d in (dx, dy))
    mi = digamma[k - 1] + digamma[n - 1] - total / n
    return pd.DataFrame({"mi": [max(0.0, float(mi))]})


def low_rank_and_sparse(m: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Robust principal components: a matrix as one of low rank and one of few large entries (augmented Lagrangian)."""
    norm, lam = np.linalg.norm(m), 1 / np.sqrt(max(m.shape))
    y, s = m / max(np.linalg.norm(m, 2), np.abs(m).max() / lam, 1e-300), np.zeros_like(m)
    mu = 1.25 / max(np.linalg.norm(m, 2), 1e-300)
    for _ in range(rounds):
        u, d, v = np.linalg.svd(m - s + y / mu, full_matrices=False)
        low = (u * np.maximum(0, d - 1 / mu)) @ v
        rest = m - low + y / mu
        s = np.sign(rest) * np.maximum(0, np.abs(rest) - lam / mu)
        gap = m - low - s
        y, mu = y + mu * gap, mu * 1.5
        if np.linalg.norm(gap) < 1e-7 * max(norm, 1e-300):
            break
    return low, s


def pairs_of_series(df: DataFrame, name: str, order: str, value: str) -> DataFrame:
    """a, b, order, x and y of each pair of series that have values at the same time: a join on time with a < b, on few series of buckets."""
    left = df.select(F.col(name).alias("a"), order, F.col(value).alias("x"))
    right = df.select(F.col(name).alias("b"), order, F.col(value).alias("y"))
    return left.join(right, order).where("a < b")
