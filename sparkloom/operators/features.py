"""What can be derived from numeric columns, which columns make a row stand out, and whether clusters are steady."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.lineage import kept
from sparkloom.operators.estimates import quantiles
from sparkloom.operators.models import rand_index


def derived(df: DataFrame, keys: list[str], order: list[str], columns: list[str], most: int = 12, ratios: int = 6) -> DataFrame:
    """feature, kind, non_null, mean and sd of what the columns of largest variance give.

    Of up to `most` columns: first (d1) and second (d2) differences and the value before (lag1) within each
    series of `keys` in `order`, and the z-score (with its mean and sample deviation); of the first `ratios` of them the
    ratio of each pair, null where the lower one is 0. Ties of variance go to the later name. One pass for the
    variances, one over the windows for all counts.
    """
    x = {c: F.col(c).cast("double") for c in columns}
    told = df.agg(*[F.struct(F.coalesce(F.var_samp(v), F.lit(0.0)).alias("v"), F.avg(v).alias("m"), F.stddev_samp(v).alias("s")).alias(c) for c, v in x.items()]).first()
    top = sorted(columns, key=lambda c: (told[c]["v"], c), reverse=True)[:most]
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumns({f"_1{i}": F.lag(x[c]).over(w) for i, c in enumerate(top)} | {f"_2{i}": F.lag(x[c], 2).over(w) for i, c in enumerate(top)})
    counts = []
    for i, c in enumerate(top):
        b, bb = F.col(f"_1{i}"), F.col(f"_2{i}")
        counts += [(f"{c}__d1", "d1", x[c] - b, c), (f"{c}__d2", "d2", x[c] - b - (b - bb), c), (f"{c}__z", "z", x[c], c), (f"{c}__lag1", "lag1", b, c)]
    counts += [(f"{a}__over__{b}", "ratio", F.when(x[b] != 0, x[a] / x[b]), None) for i, a in enumerate(top[:ratios]) for b in top[i + 1 : ratios]]
    figure = lambda kind, c, f: F.lit(None if kind != "z" else told[c][f]).cast("double").alias("mean" if f == "m" else "sd")
    parts = [F.struct(F.lit(name).alias("feature"), F.lit(kind).alias("kind"), F.count(value).alias("non_null"), figure(kind, c, "m"), figure(kind, c, "s")) for name, kind, value, c in counts]
    return rows.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def contributors(df: DataFrame, key: str, columns: list[str], most: int = 20, parts: int = 5) -> DataFrame:
    """key, score, place (from 1), column and z: the rows that stand out most by their largest robust z-score, and the columns that make them do so.

    A robust z-score is 0.6745 times the distance from the median over the median distance; a column whose
    median distance is 0 has none, a null value 0. Ties go to the smaller key and the earlier name.
    """
    # read by every pass over a column: worked out once
    df = kept(df.select(F.col(key).alias("_key"), *[F.col(c).cast("double").alias(c) for c in columns]))
    x = {c: F.col(c) for c in columns}
    z = {}
    for c, v in x.items():
        middle = quantiles(df.select(v.alias("x")), "x", [0.5])[0]
        spread = quantiles(df.select(F.abs(v - middle).alias("x")), "x", [0.5])[0]
        z[c] = F.coalesce(F.abs(0.6745 * (v - middle) / spread), F.lit(0.0)) if spread > 0 else F.lit(0.0)
    told = F.sort_array(F.array(*[F.struct((-v).alias("s"), F.lit(c).alias("c")) for c, v in z.items()]))
    top = df.select(F.col("_key").alias("key"), told.alias("t")).withColumn("score", -F.col("t")[0]["s"]).orderBy(F.desc("score"), "key").limit(most)
    return top.select("key", "score", F.posexplode(F.slice("t", 1, parts)).alias("p", "x")).select("key", "score", (F.col("p") + 1).alias("place"), F.col("x.c").alias("column"), (-F.col("x.s")).alias("z"))


def stability(df: DataFrame, key: str, columns: list[str], k: int, resamples: int = 10, share: float = 0.8, seed: int = 42) -> dict[str, float | str | int]:
    """Whether k-means gives the same clusters on samples of the rows: the mean adjusted Rand index with the clusters of all rows, its quartiles, and a verdict.

    A sample is every row whose key hashes under `share` with the resample's number, so a task that is run
    again draws the same rows; labels meet by key and only counts of label pairs leave the tasks. 0.7 is strong, 0.5 moderate.
    Fewer rows than 20 or 5 a cluster: the verdict is "too few rows". Keys are distinct.
    """
    import numpy as np
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    flat = df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    rows = kept(VectorAssembler(inputCols=columns, outputCol="features").transform(flat).select("key", "features"))
    n = rows.count()
    if n < max(20, 5 * k):
        return {"n": n, "resamples": 0, "verdict": "too few rows"}
    whole = kept(KMeans(k=k, seed=seed).fit(rows).transform(rows).select("key", F.col("prediction").alias("a")))
    found = []
    for b in range(resamples):
        drawn = rows.where(F.pmod(F.xxhash64(F.lit(seed), F.lit(b), "key"), F.lit(1_000_000)) < share * 1_000_000)
        labels = KMeans(k=k, seed=seed + b + 1).fit(drawn).transform(drawn).select("key", F.col("prediction").alias("b"))
        ari = rand_index(whole, labels, "key", "a", "b").first()["ari"]
        found.append(1.0 if ari is None else float(ari))
    mean = float(np.mean(found))
    return {"n": n, "resamples": resamples, "stability": mean, "p25": float(np.quantile(found, 0.25)), "p75": float(np.quantile(found, 0.75)), "verdict": "strong" if mean >= 0.7 else "moderate" if mean >= 0.5 else "weak"}
