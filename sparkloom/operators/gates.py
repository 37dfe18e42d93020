"""The steps of an advanced analysis, each with what a table must have for it; one profile of the table decides which apply."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.lineage import kept

from . import autoregression, estimates, forecasting, graphs, models, patterns, resampling, slices, stats, structure
from .profile import numeric_columns


@dataclass(frozen=True)
class Facts:
    """What a gate may ask about a table."""

    rows: int
    numbers: tuple[str, ...]
    time: str | None
    entity: str | None
    cv: float
    named: dict[str, str | None]
    binary: str | None
    compositional: bool


@dataclass(frozen=True)
class Step:
    """name, least numbers of columns and rows, a further need (its reason, and whether it holds), and the operator that runs."""

    name: str
    columns: int
    rows: int
    need: str = ""
    holds: Callable[[Facts], bool] = lambda f: True
    run: Callable[[DataFrame, Facts], DataFrame | dict[str, DataFrame]] | None = None


def facts(df: DataFrame) -> Facts:
    """One aggregation over the table, and gaps of its time column."""
    pick = lambda p: next((c for c in df.columns if re.search(p, c.lower())), None)
    times = [c for c, t in df.dtypes if t.startswith(("timestamp", "date"))]
    others = [c for c, t in df.dtypes if t in ("string", "int", "bigint")]
    named = {k: pick(p) for k, p in {"duration": "duration|survival|(^|_)days?$", "event": "(^|_)event$|died|churn", "lat": "^lat|latitude|_lat$", "lon": "^lon|longitude|_lon$", "source": structure.ORIGIN, "target": structure.DESTINATION}.items()}
    found = df.agg(F.count("*").alias("_n"), *[F.approx_count_distinct(c).alias(c) for c in others], *[F.struct(F.min(c).alias("a"), F.max(c).alias("b"), F.count_distinct(F.when(F.col(c).isin(0, 1), F.col(c))).alias("k")).alias(f"_{c}") for c in numeric_columns(df)]).first()
    ids = [c for c in others if 2 <= found[c] <= 50 and not c.startswith("_")]
    numbers = tuple(c for c in numeric_columns(df) if not re.search(structure.ID_NAMES + "|key$", c.lower()))
    binary = next((c for c in numbers if found[f"_{c}"]["k"] == 2 and found[f"_{c}"]["a"] == 0 and found[f"_{c}"]["b"] == 1), None)
    cv = 0.0
    if times:
        gaps = df.select(F.unix_micros(F.col(times[0]).cast("timestamp")).alias("t")).where("t IS NOT NULL").distinct()
        spread = estimates.running(gaps.select(F.col("t").cast("double").alias("t"), F.lit(1).alias("one")), "t", {"i": "one"})
        told = spread.select("i", "t").alias("a").join(spread.select((F.col("i") - 1).alias("i"), F.col("t").alias("u")).alias("b"), "i").agg((F.stddev_pop(F.col("u") - F.col("t")) / F.avg(F.col("u") - F.col("t"))).alias("cv")).first()
        cv = told["cv"] or 0.0
    mixed = len(numbers) >= 2 and bool(structure.compositional(df.dropna(subset=list(numbers)), list(numbers)).first()["is_compositional"])
    return Facts(found["_n"], numbers, times[0] if times else None, ids[0] if ids else None, cv, named, binary, mixed)


def _long(df: DataFrame, f: Facts, most: int) -> DataFrame:
    """column, at, v: of each number at most `most` places, evenly spaced in the order of time (of the rows' hashes without one)."""
    order = ["_o", "_h"]
    h = F.xxhash64(*[F.col(f"`{c}`") for c in f.numbers])
    at = F.unix_micros(F.col(f.time).cast("timestamp")) if f.time else h
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in f.numbers])
    rows = slices.numbered(df.select(at.alias("_o"), h.alias("_h"), F.explode(cells).alias("e")).select("_o", "_h", "e.column", "e.v"), ["column"], order, ["v"])
    sizes = rows.groupBy("column").agg((F.max("at") + 1).alias("n"))
    step = F.greatest(F.lit(1), F.ceil(F.col("n") / most))
    return rows.join(slices.sized(sizes), "column").where(F.col("at") % step == 0).select("column", "at", F.get("x", F.lit(0)).alias("v"))


def _sampled(df: DataFrame, f: Facts, most: int) -> DataFrame:
    """At most about `most` complete rows of the numbers, by a hash of them, with `_key`."""
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in f.numbers]).dropna()
    h = F.xxhash64(*f.numbers)
    share = min(1.0, most / max(1, f.rows))
    some = rows.where(F.pmod(F.xxhash64(h), F.lit(1_000_000)) < int(share * 1_000_000) if share < 1 else F.lit(True))
    return slices.numbered(some.withColumn("_h", h), [], ["_h"], list(f.numbers)).select(F.col("at").alias("_key"), *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(f.numbers)])


def _standard(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    told = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in names]).first()
    return df.withColumns({c: (F.col(c) - (told[c]["m"] or 0.0)) / (told[c]["s"] or 1.0) for c in names})


def _each(frames: list[tuple[str, DataFrame]]) -> DataFrame:
    """Frames under one another, each with its column's name first."""
    out = None
    for name, frame in frames:
        one = frame.select(F.lit(name).alias("column"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def _granger(df: DataFrame, f: Facts) -> DataFrame:
    return autoregression.granger(df.select(f.time, *[F.col(c).cast("double").alias(c) for c in f.numbers]), [], [f.time], list(f.numbers), 3)


def _regimes(df: DataFrame, f: Facts) -> DataFrame:
    """On 2,000 places of each number, two to four states by BIC."""
    return patterns.each_series(_long(df, f, 2000), ["column"], ["at"], ["v"], patterns.hidden_regimes, "at long, regime long, states long")


def _waves(df: DataFrame, f: Facts) -> DataFrame:
    return patterns.each_series(_long(df, f, 3000), ["column"], ["at"], ["v"], patterns.ridge_of_waves, "at long, period double, power double")


def _periods(df: DataFrame, f: Facts) -> DataFrame:
    """frequency (per second), power and false_alarm of the strongest of 200 frequencies of each number, if its chance is below 0.05."""
    seconds = F.unix_micros(F.col(f.time).cast("timestamp")) / 1e6
    lo, hi = df.agg(F.min(seconds), F.max(seconds)).first()
    grid = [i / (2 * max(hi - lo, 1e-9)) for i in range(2, 202)]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in f.numbers])
    rows = df.where(F.col(f.time).isNotNull()).select((seconds - lo).alias("s"), F.explode(cells).alias("e")).select("s", "e.column", "e.v").where("v IS NOT NULL")
    power = forecasting.periodogram(rows, ["column"], F.col("s"), "v", grid)
    best = power.groupBy("column").agg(F.max_by(F.struct("frequency", "power"), "power").alias("b")).select("column", "b.*")
    return best.withColumn("false_alarm", 1 - F.pow(1 - F.exp(-F.col("power")), F.lit(len(grid)))).where("false_alarm < 0.05")


def _levels(df: DataFrame, f: Facts) -> DataFrame:
    """A local level with its band, and the next steps, on 2,000 places of each number."""
    return patterns.each_series(_long(df, f, 2000), ["column"], ["at"], ["v"], patterns.smoothed, "at long, level double, low double, high double")


def _dynamics(df: DataFrame, f: Facts) -> DataFrame:
    """On 5,000 places in the order of time."""
    rows = slices.numbered(df, [], [f.time], list(f.numbers))
    step = max(1, -(-f.rows // 5000))
    thin = rows.where(F.col("at") % step == 0).select(F.lit(0).alias("_k"), "at", *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(f.numbers)])
    return models.dynamics(thin, ["_k"], ["at"], list(f.numbers))


def _bars(df: DataFrame, f: Facts) -> DataFrame:
    """components, first and second longest life of 2,000 rows' components, and whether they are one blob (no life twice the next one's)."""
    bars = kept(graphs.components_born_and_dead(_standard(_sampled(df, f, 2000), f.numbers), "_key", list(f.numbers)).where("death IS NOT NULL"))
    lives = [r["death"] for r in bars.orderBy(F.desc("death")).limit(6).collect()]
    gap = next((i + 1 for i, (a, b) in enumerate(zip(lives, lives[1:], strict=False)) if a > 2 * b), 0)
    return df.sparkSession.createDataFrame([(gap + 1, lives[0] if lives else None, lives[1] if len(lives) > 1 else None, gap == 0)], "components int, longest double, second double, single_blob boolean")


def _power(df: DataFrame, f: Facts) -> DataFrame:
    """Of each number that differs by 0.05 deviations or more between the groups of the binary column: the effect, and the rows that a group needs to find it (level 0.05, power 0.8)."""
    t = F.col(f.binary) == 1
    told = _each([(c, stats.cohens_d(df.dropna(subset=[c, f.binary]), c, t)) for c in f.numbers if c != f.binary])
    effect = next(c for c in told.columns if c in ("d", "cohens_d"))
    return told.where(F.abs(effect) >= 0.05).select("column", F.col(effect).alias("effect"), F.ceil(2 * (1.959964 + 0.841621) ** 2 / F.col(effect) ** 2).alias("rows_needed"))


def _clusters(df: DataFrame, f: Facts) -> dict[str, DataFrame]:
    """Rows of each of two to six clusters of 20,000 rows, and how far two halves' clusters agree (adjusted Rand index)."""
    rows = kept(_standard(_sampled(df, f, 20_000), f.numbers))
    found, k = models.clusters(rows, "_key", list(f.numbers), (2, 3, 4, 5, 6))
    seen = []
    for half in (0, 1):
        part = rows.where(F.pmod(F.xxhash64("_key"), F.lit(2)) == half)
        names = KMeans(k=k, seed=7 + half).fit(part.select(array_to_vector(F.array(*f.numbers)).alias("features")))
        seen.append(names.transform(rows.withColumn("features", array_to_vector(F.array(*f.numbers)))).select("_key", F.col("prediction").alias(f"c{half}")))
    return {"clusters": found.groupBy("cluster").agg(F.count("*").alias("n")), "cluster_stability": models.rand_index(*seen, "_key", "c0", "c1")}


def _posteriors(df: DataFrame, f: Facts) -> DataFrame:
    """column, n, mean, low and high: the posterior of each number's mean with a flat prior."""
    cells = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).cast("double").alias("mean"), (F.stddev_samp(c) / F.sqrt(F.count(c))).alias("se")) for c in f.numbers]
    told = df.agg(F.array(*cells).alias("a")).select(F.inline("a"))
    return told.select("column", "n", "mean", (F.col("mean") - 1.959963984540054 * F.col("se")).alias("low"), (F.col("mean") + 1.959963984540054 * F.col("se")).alias("high"))


def _binned(df: DataFrame, f: Facts, bins: int = 8) -> DataFrame:
    """The table with `_bin`, its eighth of the span of time."""
    t = F.unix_micros(F.col(f.time).cast("timestamp"))
    lo, hi = df.agg(F.min(t), F.max(t)).first()
    return df.where(F.col(f.time).isNotNull() & F.col(f.entity).isNotNull()).withColumn("_bin", F.least(F.lit(bins - 1), F.floor((t - lo) / max(1, hi - lo) * bins)).cast("int"))


def _panel(df: DataFrame, f: Facts) -> DataFrame:
    rows = kept(_binned(df, f))
    return _each([(c, resampling.panel_share_intervals(rows, f.entity, "_bin", c)) for c in f.numbers])


def _survival(df: DataFrame, f: Facts) -> dict[str, DataFrame]:
    died, duration = F.col(f.named["event"]) == 1, f.named["duration"]
    out = {"survival": estimates.kaplan_meier(df.dropna(subset=[duration]), duration, died)}
    covariates = [c for c in f.numbers if c not in (duration, f.named["event"])]
    if covariates:
        out["hazards"] = estimates.cox(df.dropna(subset=[duration, *covariates]), duration, died, covariates)
    return out


def _spatial(df: DataFrame, f: Facts) -> DataFrame:
    x, y = f.named["lon"], f.named["lat"]
    places = [c for c in f.numbers if c not in (x, y)]
    rows = slices.numbered(df.select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys([x, y, *f.numbers])]).dropna().withColumn("_h", F.xxhash64(x, y, *f.numbers)), [], ["_h"], [x, y, *places])
    flat = kept(rows.select(F.col("at").alias("_key"), *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate([x, y, *places])]))
    return _each([(c, resampling.moran_permutations(flat, "_key", x, y, c)) for c in places])


def _network(df: DataFrame, f: Facts) -> dict[str, DataFrame]:
    ends = df.select(*[F.col(f.named[k]).cast("string").alias(k) for k in ("source", "target")]).dropna()
    nodes = ends.select(F.explode(F.array("source", "target")).alias("name")).groupBy("name").agg(F.count("*").alias("degree"))
    communities, levels = graphs.louvain(ends.select(F.xxhash64("source").alias("a"), F.xxhash64("target").alias("b")))
    named = nodes.join(communities, F.xxhash64("name") == communities["node"]).select("name", "degree", "community")
    return {"network": levels, "network_nodes": named}


def _treatment(df: DataFrame, f: Facts) -> DataFrame:
    """The effect of the binary column on each other number, on entities that have rows in every eighth of the time."""
    rows = kept(_binned(df, f))
    out = []
    for c in f.numbers:
        if c == f.binary:
            continue
        cells = kept(rows.dropna(subset=[c, f.binary]).groupBy(f.entity, "_bin").agg(F.max(f.binary).cast("double").alias("_treated"), F.avg(c).alias("_y")))
        whole = cells.groupBy(f.entity).agg(F.count("*").alias("n")).where("n = 8").select(f.entity)
        out.append((c, resampling.wild_cluster(cells.join(whole, f.entity, "left_semi"), f.entity, "_bin", "_treated", "_y")))
    return _each(out)


STEPS = (
    Step("composition", 2, 1, "rows form no composition", lambda f: f.compositional, lambda d, f: structure.compositional(d, list(f.numbers))),
    Step("mutual_information", 2, 20, run=lambda d, f: models.pairwise_information(d, list(f.numbers))),
    Step("granger", 2, 30, "no time axis", lambda f: f.time is not None, _granger),
    Step("hidden_regimes", 1, 50, run=_regimes),
    Step("wavelets", 1, 32, run=_waves),
    Step("uneven_periods", 1, 16, "times are even", lambda f: f.time is not None and f.cv >= 0.05, _periods),
    Step("interpolation", 1, 8, run=_levels),
    Step("sparse_dynamics", 2, 50, "no time axis", lambda f: f.time is not None, _dynamics),
    Step("components", 2, 4, run=_bars),
    Step("power", 2, 4, "no groups to compare", lambda f: f.binary is not None, _power),
    Step("clusters", 2, 30, run=_clusters),
    Step("posteriors", 1, 5, run=_posteriors),
    Step("panel", 1, 4, "no time axis and entities", lambda f: f.time is not None and f.entity is not None, _panel),
    Step("survival", 1, 10, "no duration and event", lambda f: bool(f.named["duration"] and f.named["event"]), _survival),
    Step("spatial", 3, 5, "no latitude and longitude", lambda f: bool(f.named["lat"] and f.named["lon"]), _spatial),
    Step("network", 0, 1, "no source and target", lambda f: bool(f.named["source"] and f.named["target"]), _network),
    Step("treatment", 2, 4, "no panel with a binary treatment", lambda f: f.time is not None and f.entity is not None and f.binary is not None, _treatment),
)


def gated(df: DataFrame, steps: tuple[Step, ...] = STEPS) -> DataFrame:
    """place, step, applied and reason of every step, in order."""
    f = facts(df)
    rows = []
    for i, s in enumerate(steps, 1):
        reason = f"fewer than {s.columns} numbers" if len(f.numbers) < s.columns else f"fewer than {s.rows} rows" if f.rows < s.rows else s.need if not s.holds(f) else None
        rows.append((i, s.name, reason is None, reason))
    return df.sparkSession.createDataFrame(rows, "place int, step string, applied boolean, reason string")


def run(df: DataFrame, steps: tuple[Step, ...] = STEPS) -> dict[str, DataFrame]:
    """The results of the steps that apply, by step; steps of two results have a second name."""
    f = facts(df)
    out: dict[str, DataFrame] = {}
    for s in steps:
        if s.run and len(f.numbers) >= s.columns and f.rows >= s.rows and s.holds(f):
            found = s.run(df, f)
            out |= found if isinstance(found, dict) else {s.name: found}
    return out
