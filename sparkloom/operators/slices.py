"""Long series cut into overlapping slices, so that no task holds a whole series.

`numbered` gives each row its place in its series by a range partitioning and the sums of
the pieces' sizes; `slices` makes arrays of `width` places and a halo of the next ones, so
that every window lies in the slice in which it begins. What compares all windows with all
deals pairs of slices out; what looks at a window alone is done slice by slice.

Rows with a null key, order or value are left out. Rows of equal order go by their values.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.lineage import kept

#: Places of a slice.
WIDTH = 20_000
#: Rows that a table may have to be broadcast.
FEW = 100_000


def sized(df: DataFrame, most: int = FEW) -> DataFrame:
    """The table, to be broadcast if it has at most so many rows; they are counted."""
    return F.broadcast(df) if df.count() <= most else df


def numbered(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """keys, order, at (place in the series, from 0) and x (the values as an array)."""
    rows = df.select(*keys, *[c for c in order if c not in keys], F.array(*[F.col(v).cast("double") for v in values]).alias("x"))
    rows = rows.where(F.forall("x", lambda v: v.isNotNull())).dropna(subset=[*keys, *order])
    named = [c for c in rows.columns if c != "x"]

    def count(batches):
        piece, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            of = [batch.column(k).to_pylist() for k in keys]
            nth = np.empty(batch.num_rows, np.int64)
            for i, key in enumerate(zip(*of, strict=True) if keys else [()] * batch.num_rows):
                n = n + 1 if key == last else 0
                nth[i], last = n, key
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(nth), piece), pa.int32()), pa.array(nth)], [*batch.schema.names, "piece", "nth"])

    told = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes)
    dealt = rows.repartitionByRange(*named).sortWithinPartitions(*named, "x").mapInArrow(count, f"{told}, piece int, nth long")
    # written, as the pieces of a range partitioning are not the same when they are made anew
    dealt = kept(dealt)
    before = Window.partitionBy(*keys).orderBy("piece")
    sizes = dealt.groupBy(*keys, "piece").agg(F.count("*").alias("n"))
    sizes = sizes.select(*keys, "piece", (F.sum("n").over(before) - F.col("n")).alias("before"))
    return dealt.join(sized(sizes), [*keys, "piece"]).select(*named, (F.col("before") + F.col("nth")).alias("at"), "x")


def slices(rows: DataFrame, keys: list[str], halo: int, width: int = WIDTH) -> DataFrame:
    """keys, slice, start (its first place) and xs (the values of its places and of the next `halo`) of numbered rows."""
    if halo > width:
        raise ValueError("a halo is at most as wide as a slice")
    own = F.floor(F.col("at") / width).cast("int")
    also = F.when((F.col("at") % width < halo) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))
    each = rows.select(*keys, F.explode(also).alias("slice"), F.struct("at", "x").alias("row"))
    found = each.groupBy(*keys, "slice").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return found.select(*keys, "slice", (F.col("slice").cast("long") * width).alias("start"), F.col("rows.x").alias("xs"))


def windows(rows: DataFrame, keys: list[str], window: int, width: int = WIDTH) -> DataFrame:
    """keys, at and w of every window of numbered rows: its values, place after place."""
    cut = slices(rows, keys, window - 1, width).where(F.size("xs") >= window)
    places = F.sequence(F.lit(1), F.size("xs") - window + 1)
    each = cut.select(*keys, "start", F.posexplode(F.transform(places, lambda i: F.flatten(F.slice("xs", i, F.lit(window))))).alias("i", "w"))
    # the last places of a slice belong to the next one, where they are in both
    return each.where(F.col("i") < width).select(*keys, (F.col("start") + F.col("i")).alias("at"), "w")


def _standard(xs: np.ndarray, window: int, width: int) -> np.ndarray:
    """The standardised windows that begin in a slice; those of one value only are zero."""
    if len(xs) < window:
        return np.zeros((0, window))
    w = np.lib.stride_tricks.sliding_window_view(xs, window)[:width]
    sd = w.std(axis=1, keepdims=True)
    flat = sd <= 1e-12
    return np.where(flat, 0.0, (w - w.mean(axis=1, keepdims=True)) / np.where(flat, 1.0, sd))


def _nearest(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, apart: int) -> tuple[tuple, tuple]:
    """For the windows of both slices the distance to the nearest of the other, and its place."""
    far_a, near_a = np.full(len(a), np.inf), np.full(len(a), -1)
    far_b, near_b = np.full(len(b), np.inf), np.full(len(b), -1)
    square = (b**2).sum(axis=1)
    for i in range(0, len(a), 256):
        part = a[i : i + 256]
        d = np.maximum(0, (part**2).sum(axis=1)[:, None] + square - 2 * part @ b.T)
        d[np.abs(at_a[i : i + 256, None] - at_b) < apart] = np.inf
        j = d.argmin(axis=1)
        far_a[i : i + 256], near_a[i : i + 256] = d[np.arange(len(part)), j], at_b[j]
        k = d.argmin(axis=0)
        least = d[k, np.arange(len(b))]
        closer = least < far_b
        far_b[closer], near_b[closer] = least[closer], at_a[i + k[closer]]
    return (far_a, near_a), (far_b, near_b)


def profile(df: DataFrame, keys: list[str], order: list[str], value: str, window: int, width: int = WIDTH) -> DataFrame:
    """at, distance and nearest: each window's nearest other window by standardised distance, half a window apart at least.

    Each pair of slices is one task's work, so a series of n values is n / width slices and
    half their square of tasks; what they tell of a window is reduced to its minimum before
    it is shuffled. Windows without a partner are left out.
    """
    cut = kept(slices(numbered(df, keys, order, [value]), keys, window - 1, width))
    blocks = cut.groupBy(*keys).agg((F.max("slice") + 1).alias("blocks"))
    both = cut.join(sized(blocks), keys) if keys else cut.crossJoin(F.broadcast(blocks))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = both.withColumn("other", other).select(*keys, F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"), "slice", "start", F.flatten("xs").alias("xs"))
    apart = max(1, window // 2)

    def pairs(table: pa.Table) -> pa.Table:
        order_ = np.argsort(table.column("slice").to_numpy())
        z = [_standard(table.column("xs")[int(k)].values.to_numpy(), window, width) for k in order_]
        at = [table.column("start")[int(k)].as_py() + np.arange(len(v)) for k, v in zip(order_, z, strict=True)]
        if not all(len(v) for v in z):
            told = []
        elif len(z) == 1:
            told = [(at[0], *_nearest(z[0], at[0], z[0], at[0], apart)[0])]
        else:
            a, b = _nearest(z[0], at[0], z[1], at[1], apart)
            told = [(at[0], *a), (at[1], *b)]
        at_, far, near = (np.concatenate([np.zeros(0), *c]) for c in zip(*told, strict=True)) if told else (np.zeros(0),) * 3
        some = np.isfinite(far)
        at_, far, near = at_[some].astype(np.int64), np.sqrt(far[some]), near[some].astype(np.int64)
        of = [pa.array([table.column(k)[0].as_py()] * len(at_), table.schema.field(k).type) for k in keys]
        return pa.table([*of, pa.array(at_), pa.array(far), pa.array(near)], [*keys, "at", "distance", "nearest"])

    types = dict(cut.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "at long, distance double, nearest long"])
    told = dealt.groupBy(*keys, "i", "j").applyInArrow(pairs, schema)
    return told.groupBy(*keys, "at").agg(F.min(F.struct("distance", "nearest")).alias("best")).select(*keys, "at", "best.distance", "best.nearest")


def _picked(found: DataFrame, keys: list[str], window: int, kind: str, most: int) -> list[DataFrame]:
    """kind, rank, at, other and distance of the first rows of a profile that overlap no earlier one, a table each."""
    left, chosen = found, []
    for rank in range(1, most + 1):
        first = F.struct((F.col("distance") if kind == "motif" else -F.col("distance")).alias("by"), "at", "nearest", "distance")
        best = left.groupBy(*keys).agg(F.min(first).alias("b")).where("b IS NOT NULL")
        best = kept(best.select(*keys, F.col("b.at").alias("_at"), F.col("b.nearest").alias("_other"), F.col("b.distance").alias("_distance")))
        chosen.append(best.select(*keys, F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), F.col("_at").alias("at"), F.col("_other").alias("other"), F.col("_distance").alias("distance")))
        spots, taken = (("at", "nearest"), ("_at", "_other")) if kind == "motif" else (("at",), ("_at",))
        clear = F.lit(True)
        for s in spots:
            for t in taken:
                clear &= F.abs(F.col(s) - F.col(t)) >= window
        met = left.join(sized(best), keys) if keys else left.crossJoin(F.broadcast(best))
        left = met.where(clear).select(*found.columns)
    return chosen


def _together(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def motifs_and_discords(found: DataFrame, keys: list[str], window: int, most: int = 3) -> DataFrame:
    """kind (motif or discord), rank, at, other and distance: of a profile the nearest pairs of windows and the windows furthest from all others, none overlapping an earlier one."""
    found = kept(found)
    return _together([c for kind in ("motif", "discord") for c in _picked(found, keys, window, kind, most)])


def motif_library(told: DataFrame, k: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Of windows (at, w): the table of motifs (motif, centroid, n), and the windows with their motif; k-means over all windows of all series."""
    rows = kept(told.withColumn("features", array_to_vector("w")))
    model = KMeans(k=k, seed=seed, maxIter=50).fit(rows.select("features"))
    labelled = kept(model.transform(rows).withColumnRenamed("prediction", "motif").drop("features"))
    sizes = labelled.groupBy("motif").agg(F.count("*").alias("n"))
    centres = told.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "motif int, centroid array<double>")
    return centres.join(sizes, "motif"), labelled


def euclidean(x, y):
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def similar_to_latest(labelled: DataFrame, library: DataFrame, keys: list[str], top_motifs: int = 3, top_windows: int = 5) -> DataFrame:
    """For the last window of each series: the nearest motifs, and of their windows (of any series, but itself) the nearest: keys, motif, rank, other keys and place, distance.

    The library has a row a motif and is broadcast; so are the last windows, a row a series, if they are few.
    """
    last = labelled.groupBy(*keys).agg(F.max_by(F.struct("at", "w"), "at").alias("l")).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("l.at").alias("_at"), F.col("l.w").alias("_w"))
    of = [f"_{k}" for k in keys]
    near = Window.partitionBy(*of).orderBy("_d", "motif")
    asked = last.crossJoin(F.broadcast(library.select("motif", "centroid"))).withColumn("_d", euclidean(F.col("_w"), F.col("centroid")))
    asked = kept(asked.withColumn("motif_rank", F.row_number().over(near)).where(F.col("motif_rank") <= top_motifs).drop("centroid", "_d"))
    itself = F.col("at") == F.col("_at")
    for k in keys:
        itself &= F.col(k) == F.col(f"_{k}")
    met = labelled.join(sized(asked), "motif").where(~itself).withColumn("distance", euclidean(F.col("w"), F.col("_w")))
    order = Window.partitionBy(*of).orderBy("distance", *keys, "at")
    best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_windows)
    return best.select(*of, "motif", "motif_rank", "rank", *keys, "at", "distance")


def regime_labels(rows: DataFrame, keys: list[str], window: int = 10, k: int = 3, seed: int = 42) -> DataFrame:
    """Numbered rows with `regime`: the cluster of the window that ends there, numbered by the first value of the centres; -1 before the first window's end."""
    library, labelled = motif_library(windows(rows, keys, window), k, seed)
    order = {r["motif"]: i for i, r in enumerate(library.orderBy("centroid").select("motif").collect())}
    names = F.create_map(*[x for m, i in order.items() for x in (F.lit(m), F.lit(i))])
    ends = labelled.select(*keys, (F.col("at") + window - 1).alias("at"), F.try_element_at(names, F.col("motif")).alias("regime"))
    return rows.join(ends, [*keys, "at"], "left").withColumn("regime", F.coalesce("regime", F.lit(-1)))


def regimes_and_anomalies(df: DataFrame, columns: Sequence[str], k: int = 3, seed: int = 42) -> DataFrame:
    """Rows without nulls in `columns` with `regime` (a cluster of their two principal components, numbered from the largest) and `score` (the distance from its centre)."""
    rows = kept(df.dropna(subset=list(columns)).withColumn("_v", array_to_vector(F.array(*[F.col(c).cast("double") for c in columns]))))
    parts = kept(PCA(k=min(2, len(columns)), inputCol="_v", outputCol="_p").fit(rows).transform(rows).withColumn("features", F.col("_p")))
    model = KMeans(k=k, seed=seed, maxIter=50).fit(parts)
    found = model.transform(parts)
    sizes = [r["prediction"] for r in found.groupBy("prediction").count().orderBy(F.desc("count"), "prediction").collect()]
    names = F.create_map(*[x for i, p in enumerate(sizes) for x in (F.lit(p), F.lit(i))])
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    score = euclidean(vector_to_array("_p"), F.get(centres, F.col("prediction")))
    return found.select(*df.columns, F.try_element_at(names, F.col("prediction")).alias("regime"), score.alias("score"))


def by_regime(df: DataFrame, columns: Sequence[str], target: str, k: int = 3, least: int = 15, seed: int = 42) -> DataFrame:
    """A line through each regime of regimes_and_anomalies: regime, n, and the coefficients (intercept first) and R2 of `target` on `columns`; regimes of fewer than `least` rows are left out.

    One aggregate of cross-products for each regime; the systems, a row each, are solved on the driver.
    """
    found = regimes_and_anomalies(df.dropna(subset=[target]), columns, k, seed)
    z = [F.lit(1.0), *[F.col(c).cast("double") for c in columns], F.col(target).cast("double")]
    m = len(z)
    sums = found.groupBy("regime").agg(F.count("*").alias("n"), *[F.sum(z[i] * z[j]).alias(f"s{i}_{j}") for i in range(m) for j in range(i, m)])
    out = []
    for r in sums.where(F.col("n") >= least).orderBy("regime").collect():
        g = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)])
        beta = np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=None)[0]
        total = g[-1, -1] - g[0, -1] ** 2 / g[0, 0]
        rest = g[-1, -1] - 2 * beta @ g[:-1, -1] + beta @ g[:-1, :-1] @ beta
        out.append((r["regime"], r["n"], [float(b) for b in beta], float(1 - rest / total) if total > 0 else None))
    return df.sparkSession.createDataFrame(out, "regime int, n long, coefficients array<double>, r2 double")


def hop_entropy(rows: DataFrame, keys: list[str], window: int = 64, width: int = WIDTH) -> DataFrame:
    """at, entropy (of the normalised power spectrum, 0 to 1) and jump (from the window before) of windows of numbered rows that hop by half their length."""
    hop = max(1, window // 2)

    def run(batches):
        for batch in batches:
            w = batch.column(len(keys) + 1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            power = np.abs(np.fft.rfft(w - w.mean(axis=1, keepdims=True)))[:, 1:] ** 2
            total = power.sum(axis=1, keepdims=True)
            p = power / np.where(total > 0, total, 1.0)
            e = -np.where(p > 0, p * np.log(np.where(p > 0, p, 1.0)), 0.0).sum(axis=1) / np.log(max(2, window // 2))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys) + 1], pa.array(e)], [*keys, "at", "entropy"])

    types = dict(rows.dtypes)
    told = windows(rows, keys, window, width).where(F.col("at") % hop == 0)
    found = kept(told.mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "at long, entropy double"])))
    # the window before by a join, as a lag would put a whole series in one task
    before = found.select(*keys, (F.col("at") + hop).alias("at"), F.col("entropy").alias("_e"))
    return found.join(before, [*keys, "at"], "left").withColumn("jump", F.coalesce(F.abs(F.col("entropy") - F.col("_e")), F.lit(0.0))).drop("_e")
