"""Models on tables and graphs: outlier forests, local density, clusters, centralities, communities, propagation, laws."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.lineage import kept

from .estimates import neighbours, ranked_neighbours


def isolation_scores(df: DataFrame, key: str, columns: list[str], trees: int = 50, sample: int = 256, seed: int = 7) -> DataFrame:
    """key and score (near 1: isolated early) of every row, by random trees grown on `sample` rows each.

    The trees' rows are the first of a hashed order, trees * sample at most; the trees, a few
    hundred numbers each, go to the tasks, and all rows are scored there.
    """
    flat = df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    drawn = np.array([r[1:] for r in flat.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(trees * sample).collect()], float)
    rng = np.random.default_rng(seed)
    deepest = int(np.ceil(np.log2(max(2, min(sample, len(drawn))))))
    usual = lambda n: 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(rows: np.ndarray, depth: int):
        spread = np.flatnonzero(rows.min(axis=0) < rows.max(axis=0)) if len(rows) > 1 else []
        if depth >= deepest or not len(spread):
            return depth + usual(len(rows))
        c = int(rng.choice(spread))
        cut = rng.uniform(rows[:, c].min(), rows[:, c].max())
        return c, cut, grow(rows[rows[:, c] < cut], depth + 1), grow(rows[rows[:, c] >= cut], depth + 1)

    forest = [grow(drawn[rng.integers(0, len(drawn), min(sample, len(drawn)))], 0) for _ in range(trees)] if len(drawn) else []
    norm = max(1e-9, usual(min(sample, max(2, len(drawn)))))

    def depth(tree, x: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
        if not isinstance(tree, tuple):
            out[at] += tree
            return
        left = x[at, tree[0]] < tree[1]
        depth(tree[2], x, at[left], out)
        depth(tree[3], x, at[~left], out)

    def score(frames):
        for f in frames:
            x, total = f[columns].to_numpy(float), np.zeros(len(f))
            for t in forest:
                depth(t, x, np.arange(len(x)), total)
            yield pd.DataFrame({"key": f["key"], "score": 2.0 ** (-total / max(1, len(forest)) / norm)})

    return flat.mapInPandas(score, f"key {dict(flat.dtypes)['key']}, score double")


def local_outliers(df: DataFrame, key: str, x: str, y: str, k: int) -> DataFrame:
    """key and lof: the mean reachability density of a point's k nearest over its own."""
    return _density_ratios(neighbours(df, key, x, y, k))


def local_outliers_at(df: DataFrame, key: str, x: str, y: str, counts: tuple[int, ...]) -> DataFrame:
    """key, k and lof at several neighbourhood sizes: the nearest are looked for once, at the largest size."""
    near, found = ranked_neighbours(df, key, x, y, max(counts)), None
    for k in counts:
        one = _density_ratios(near.where(F.col("r") <= k)).select("key", F.lit(k).alias("k"), "lof")
        found = one if found is None else found.unionByName(one)
    return found


def _density_ratios(near: DataFrame) -> DataFrame:
    # a row for each point is too much for the driver, so none of these tables is broadcast
    edge = near.groupBy("key").agg(F.max("distance").alias("kd"))
    reach = near.join(edge.select(F.col("key").alias("other"), "kd").hint("merge"), "other").withColumn("reach", F.greatest("distance", "kd"))
    density = kept(reach.groupBy("key").agg((1 / F.greatest(F.avg("reach"), F.lit(1e-12))).alias("density")))
    others = near.select("key", "other").join(density.select(F.col("key").alias("other"), F.col("density").alias("od")).hint("merge"), "other")
    return others.groupBy("key").agg(F.avg("od").alias("od")).join(density.hint("merge"), "key").select("key", (F.col("od") / F.col("density")).alias("lof"))


def clusters(df: DataFrame, key: str, columns: list[str], counts: tuple[int, ...] = (2, 3, 4), seed: int = 7) -> tuple[DataFrame, int]:
    """key and cluster (numbered by size) on standardised columns, the number of clusters by silhouette; Spark's own k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    flat = df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    vectors = VectorAssembler(inputCols=columns, outputCol="raw").transform(flat)
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(vectors).transform(vectors).cache()
    best = None
    for k in counts:
        found = KMeans(k=k, seed=seed, initSteps=5).fit(scaled).transform(scaled)
        quality = ClusteringEvaluator().evaluate(found)
        if best is None or quality > best[0]:
            best = (quality, k, found)
    sizes = best[2].groupBy("prediction").agg(F.count("*").alias("n"), F.min("key").alias("first"))
    ranked = sizes.withColumn("cluster", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).cast("int"))
    return best[2].join(F.broadcast(ranked.select("prediction", "cluster")), "prediction").select("key", "cluster"), best[1]


def rand_index(a: DataFrame, b: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """ari: the adjusted Rand index of two labellings, from their contingency counts."""
    pair = lambda n: n * (n - 1) / 2
    cells = a.select(key, x).join(b.select(key, y), key).groupBy(x, y).agg(F.count("*").alias("n"))
    inner = cells.agg(F.sum(pair(F.col("n"))).alias("i"), F.sum("n").alias("n"))
    rows, columns = (cells.groupBy(c).agg(F.sum("n").alias("m")).agg(F.sum(pair(F.col("m"))).alias(s)) for c, s in ((x, "r"), (y, "c")))
    expected = F.col("r") * F.col("c") / pair(F.col("n"))
    return inner.join(rows).join(columns).select(((F.col("i") - expected) / ((F.col("r") + F.col("c")) / 2 - expected)).alias("ari"))


def eigenvector(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """node and score (largest 1) of an undirected graph: power iteration, a join and a sum each round; a share of the node's own score keeps two-sided graphs from swinging."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().cache()
    score = both.select(F.col("a").alias("node")).distinct().withColumn("s", F.lit(1.0))
    for i in range(rounds):
        pulled = both.join(score, both["b"] == score["node"]).groupBy("a").agg(F.sum("s").alias("p"))
        raw = score.join(pulled, score["node"] == pulled["a"]).select("node", (F.col("s") + F.col("p")).alias("s"))
        top = raw.agg(F.max("s")).first()[0] or 1.0
        score = raw.select("node", (F.col("s") / top).alias("s"))
        if i % 4 == 3:
            score = kept(score)
    return score.withColumnRenamed("s", "score")


def propagated(edges: DataFrame, start: DataFrame, hops: int = 3) -> DataFrame:
    """node, hop, delta, confidence: a change carried along edges (src, dst, gain, confidence) for some hops; changes add up at a node, confidence is the least on the way."""
    wave, out = start.select("node", "delta", "confidence"), None
    for hop in range(1, hops + 1):
        met = wave.join(edges.withColumnRenamed("confidence", "ec"), F.col("node") == F.col("src"))
        wave = met.groupBy("dst").agg(F.sum(F.col("delta") * F.col("gain")).alias("delta"), F.min(F.least("confidence", "ec")).alias("confidence")).withColumnRenamed("dst", "node")
        told = wave.withColumn("hop", F.lit(hop))
        out = told if out is None else out.unionByName(told)
    return out


def field_laws(grid: DataFrame, time: str, place: str, value: str, dt: float, dx: float) -> DataFrame:
    """law, coefficient, r2, rmse of heat, advection and wave equations on a grid of time and place: one slope through the origin each, from windows."""
    along, over = Window.partitionBy(place).orderBy(time), Window.partitionBy(time).orderBy(place)
    u = F.col(value)
    rows = grid.withColumns({"_ut": (F.lead(u).over(along) - F.lag(u).over(along)) / (2 * dt), "_utt": (F.lead(u).over(along) - 2 * u + F.lag(u).over(along)) / dt**2, "_ux": (F.lead(u).over(over) - F.lag(u).over(over)) / (2 * dx), "_uxx": (F.lead(u).over(over) - 2 * u + F.lag(u).over(over)) / dx**2}).dropna()
    told = None
    for law, left, right in (("heat", "_ut", "_uxx"), ("advection", "_ut", "_ux"), ("wave", "_utt", "_uxx")):
        y, x = F.col(left), F.col(right)
        s = rows.agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), (F.var_pop(y) * F.count(y)).alias("vy"), F.count(y).alias("n"))
        rss = F.col("yy") - F.col("xy") ** 2 / F.col("xx")
        one = s.select(F.lit(law).alias("law"), (F.col("xy") / F.col("xx")).alias("coefficient"), (1 - rss / F.col("vy")).alias("r2"), F.sqrt(F.greatest(F.lit(0.0), rss) / F.col("n")).alias("rmse"))
        told = one if told is None else told.unionByName(one)
    return told


def consistency(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """score: 1 less for values far outside their usual span (.70) and for series that go below zero often (.90); growth: linear or exponential where it fits, monotone where nearly all steps agree."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = F.col(value)
    rows = df.withColumns({"_i": F.row_number().over(w), "_step": x - F.lag(value).over(w)})
    g = rows.groupBy(*keys).agg(F.percentile(value, F.lit(0.01)).alias("p1"), F.percentile(value, F.lit(0.99)).alias("p99"), F.max(F.abs(x)).alias("top"), F.avg((x < 0).cast("int")).alias("below"), (F.corr("_i", value) ** 2).alias("lin"), (F.corr("_i", F.when(x > 0, F.log(value))) ** 2).alias("ex"), F.avg((F.col("_step") > 0).cast("int")).alias("up"))
    score = F.when(F.col("top") > 10 * (F.col("p99") - F.col("p1")), 0.70).otherwise(1.0) * F.when(F.col("below") > 0.3, 0.90).otherwise(1.0)
    return g.select(*keys, score.alias("score"), F.when(F.col("lin") >= 0.98, "linear").when(F.col("ex") >= 0.98, "exponential").otherwise("none").alias("growth"), ((F.col("up") > 0.95) | (F.col("up") < 0.05)).alias("monotone"))


def interventions(texts: Column) -> Column:
    """What a sentence asks to change: verb (set, drop, raise), amount, unit and for how long; null where it says none."""
    low = F.lower(texts)
    verb = F.when(low.rlike(r"\bset\b"), "set").when(low.rlike(r"\b(drop|decrease|reduce|cut|lower)\b"), "drop").when(low.rlike(r"\b(increase|raise|lift|boost)\b"), "raise")
    amount = F.regexp_extract(low, r"(?:to|by|at)\s+([-+]?[0-9]+(?:[.][0-9]+)?)", 1).try_cast("double")
    percent = low.rlike(r"[0-9]\s*(%|percent)")
    span = F.regexp_extract(low, r"for\s+([0-9]+)\s+(second|minute|hour|day|week|month)", 1).try_cast("int")
    unit = F.regexp_extract(low, r"for\s+[0-9]+\s+(second|minute|hour|day|week|month)", 1)
    return F.when(verb.isNotNull() & amount.isNotNull(), F.struct(verb.alias("verb"), amount.alias("amount"), percent.alias("percent"), span.alias("span"), F.nullif(unit, F.lit("")).alias("unit")))


def hashed_tfidf(docs: DataFrame, key: str, text: str, size: int = 256) -> DataFrame:
    """key, bucket and weight: (1 + ln tf) * (ln((N + 1) / (df + 1)) + 1) of hashed words, each document's weights of length 1."""
    words = docs.select(F.col(key).alias("key"), F.explode(F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda w: w != "")).alias("w"))
    bucket = F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 8), 16, 10).cast("long") % size
    tf = words.groupBy("key", bucket.alias("bucket")).agg(F.count("*").alias("tf"))
    n = docs.count()
    df = tf.groupBy("bucket").agg(F.count("*").alias("df"))
    raw = tf.join(F.broadcast(df), "bucket").withColumn("weight", (1 + F.log("tf")) * (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1))
    norm = raw.groupBy("key").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"))
    return raw.join(norm, "key").select("key", "bucket", (F.col("weight") / F.col("norm")).alias("weight"))


def hybrid_rank(structured: DataFrame, semantic: DataFrame, k: int) -> DataFrame:
    """key and score of the best k: 0.65 of the structured and 0.35 of the semantic score, 0.1 more for hits of both, 1 at most."""
    both = structured.join(semantic, "key", "full_outer")
    score = 0.65 * F.least(F.lit(1.0), F.coalesce("s", F.lit(0.0))) + 0.35 * F.coalesce("m", F.lit(0.0)) + F.when(F.col("s").isNotNull() & F.col("m").isNotNull(), 0.1).otherwise(0.0)
    return both.select("key", F.least(F.lit(1.0), score).alias("score")).orderBy(F.desc(F.round("score", 9)), "key").limit(k)


def lin_ucb(df: DataFrame, arm: str, features: list[str], reward: str, alpha: float = 1.0) -> DataFrame:
    """arm, mean and bound of each arm at the mean context: ridge estimates from each arm's sums, a small system an arm."""
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    k = len(x)
    sums = df.groupBy(arm).agg(*[F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(x[i] * F.col(reward)).alias(f"b{i}") for i in range(k)])
    context = np.array([1.0, *[df.agg(F.avg(f)).first()[0] for f in features]])

    def solve(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float) + np.eye(k)
                inv = np.linalg.inv(a)
                mean = float(context @ inv @ np.array([r[f"b{i}"] for i in range(k)], float))
                out.append((r[arm], mean, mean + alpha * float(np.sqrt(context @ inv @ context))))
            yield pd.DataFrame(out, columns=[arm, "mean", "bound"])

    return sums.mapInPandas(solve, f"{arm} {dict(df.dtypes)[arm]}, mean double, bound double")


def false_fires(spark, cells: list[tuple[float, int]], trials: int, limit: float = 8.0) -> DataFrame:
    """phi, n, fires and rate with a Wilson interval: how often CUSUM fires on AR(1) noise without any change; trials are dealt over tasks."""
    from .patterns import cusum_points

    grid = spark.createDataFrame(cells, "phi double, n int").withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))

    def run(frames):
        for f in frames:
            out = []
            for phi, n, trial in f.itertuples(index=False):
                noise = np.random.default_rng([int(phi * 1000), int(n), int(trial)]).normal(size=int(n) + 50)
                x = np.empty_like(noise)
                x[0] = noise[0]
                for i in range(1, len(x)):
                    x[i] = phi * x[i - 1] + noise[i]
                out.append((phi, n, int(len(cusum_points(x[50:], limit=limit)) > 0)))
            yield pd.DataFrame(out, columns=["phi", "n", "fired"])

    fired = grid.repartition(16).mapInPandas(run, "phi double, n int, fired int").groupBy("phi", "n").agg(F.count("*").alias("trials"), F.sum("fired").alias("fires"))
    p, z = F.col("fires") / F.col("trials"), 1.959963984540054
    middle, half = (p + z * z / (2 * F.col("trials"))) / (1 + z * z / F.col("trials")), z * F.sqrt(p * (1 - p) / F.col("trials") + z * z / (4 * F.col("trials") ** 2)) / (1 + z * z / F.col("trials"))
    return fired.select("phi", "n", "fires", p.alias("rate"), (middle - half).alias("low"), (middle + half).alias("high"))


def conditional_information(df: DataFrame, a: str, b: str, given: str, bins: int = 6) -> DataFrame:
    """cmi in nats of two columns given a third, all in equal-width bins, from joint counts."""
    names = (a, b, given)
    lo = df.agg(*[f(c).cast("double").alias(f"{n}{i}") for i, c in enumerate(names) for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    cell = lambda c, i: F.least(F.lit(bins - 1), F.floor((F.col(c) - lo[f"lo{i}"]) / ((lo[f"hi{i}"] - lo[f"lo{i}"]) or 1.0) * bins)).cast("int")
    joint = df.dropna(subset=list(names)).groupBy(*[cell(c, i).alias(n) for i, (c, n) in enumerate(zip(names, "xyz", strict=True))]).agg(F.count("*").alias("n"))
    over = lambda *k: F.sum("n").over(Window.partitionBy(*k))
    return joint.select((F.col("n") / over() * F.log(F.col("n") * over("z") / (over("x", "z") * over("y", "z")))).alias("t")).agg(F.sum("t").alias("cmi"))


def pairwise_information(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """a, b and mi of every pair of columns, from one pass of joint counts."""
    lo = df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    cell = lambda c: F.least(F.lit(bins - 1), F.floor((F.col(c) - lo[f"lo_{c}"]) / ((lo[f"hi_{c}"] - lo[f"lo_{c}"]) or 1.0) * bins)).cast("int")
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), cell(a).alias("i"), cell(b).alias("j")) for n, a in enumerate(columns) for b in columns[n + 1 :]]
    joint = df.dropna(subset=columns).select(F.explode(F.array(*pairs)).alias("p")).select("p.*").groupBy("a", "b", "i", "j").agg(F.count("*").alias("n"))
    over = lambda *k: F.sum("n").over(Window.partitionBy("a", "b", *k))
    return joint.select("a", "b", (F.col("n") / over() * F.log(F.col("n") * over() / (over("i") * over("j")))).alias("t")).groupBy("a", "b").agg(F.sum("t").alias("mi"))


def dynamics(df: DataFrame, keys: list[str], order: list[str], states: list[str], degree: int = 2, cut: float = 0.05) -> DataFrame:
    """state, term and coefficient of sparse dynamics: changes regressed on a library of products, small terms dropped and the rest fitted again."""
    from itertools import combinations_with_replacement

    w = Window.partitionBy(*keys).orderBy(*order)
    scale = df.agg(*[F.stddev_pop(s).alias(s) for s in states]).first()
    unit = df.withColumns({s: F.col(s) / (scale[s] or 1.0) for s in states})
    rows = unit.withColumns({f"_d_{s}": F.lead(s).over(w) - F.col(s) for s in states}).dropna()
    terms = [(), *[c for k in range(1, degree + 1) for c in combinations_with_replacement(states, k)]]
    value = lambda t: reduce(lambda p, q: p * q, [F.col(s) for s in t], F.lit(1.0))
    names = [*map(value, terms), *[F.col(f"_d_{s}") for s in states]]
    n = len(names)
    got = rows.agg(*[F.avg(names[i] * names[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    m = np.array([[got[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    out = []
    for s, name in enumerate(states):
        keep = np.arange(len(terms))
        for _ in range(10):
            c = np.linalg.lstsq(m[np.ix_(keep, keep)], m[keep, len(terms) + s], rcond=None)[0]
            large = np.abs(c) >= cut
            if large.all():
                break
            keep = keep[large]
        out += [(name, "*".join(terms[i]) or "1", float(v)) for i, v in zip(keep, c[: len(keep)], strict=False)]
    return df.sparkSession.createDataFrame(out, "state string, term string, coefficient double")
