"""Nearest rows of a stated set of queries among all rows of a table, exactly.

The queries travel to the rows in blocks of a checked size: each task holds one
block and the best rows it has met so far for each of the block's queries. What
is shuffled is k rows for each query and task, never the table. Short vectors go by
stretches of one coordinate instead: the best rows of a query's own stretch bound how far
others can lie, so it meets few of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.lineage import kept
from sparkloom.packaging import shipped

#: Scores are compared to this many decimals, so that sums in another order give the same ranks.
DECIMALS = 9
#: Components of vectors that go by stretches, rows of a stretch, about, and rows of it that a task holds at most, about.
SHORT, STRETCH, HELD = 4, 5_000, 50_000


def _scores(metric: str, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Scores of each query (row) with each vector (column); larger is nearer."""
    if metric == "euclidean":
        # differences are taken outright: the expanded square would lose the distance of near copies
        out = np.empty((len(q), len(m)))
        step = max(1, 4_000_000 // max(1, m.size))
        for i in range(0, len(q), step):
            out[i : i + step] = -np.sqrt(((q[i : i + step, None, :] - m[None, :, :]) ** 2).sum(axis=2))
        return out
    dots = q @ m.T
    if metric == "inner":
        return dots
    norms = np.sqrt((q**2).sum(axis=1))[:, None] * np.sqrt((m**2).sum(axis=1))[None, :]
    return np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)


def _best(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    return rows.sort_values(["q", "score", "key"], ascending=[True, False, True], kind="stable").groupby("q", sort=False).head(k)


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key and v (doubles) of the rows whose key and vector are there, without null, infinite or undefined components."""
    v = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(key).alias("key"), v.alias("v")).where(F.col("key").isNotNull() & F.col("v").isNotNull()).where(sound)


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, metric: str = "cosine", itself: bool = False, block_bytes: int = 4 << 20) -> DataFrame:
    """query_id, key and score of the k nearest rows of each query: all, if fewer; ties to the smaller key.

    metric is cosine (0 where a vector has no length), inner or euclidean (the score is the
    distance below zero). Rows of a query's own key are left out unless `itself`. Rows without a key or
    with null, infinite or undefined components take no part, nor do rows of another length than a query's.
    A key that several queries share is asked once for each of its vectors, and they share one list. Queries
    are gathered in blocks of at most about `block_bytes`; rows are read once for each block.
    """
    if metric not in ("cosine", "inner", "euclidean"):
        raise ValueError(f"no such metric: {metric}")
    asked = _usable(queries, key, vector).cache()
    size = asked.agg(F.count("*").alias("n"), F.sum(16 + 8 * F.size("v")).alias("bytes"), F.max(16 + 8 * F.size("v")).alias("widest")).first()
    kind = dict(rows.dtypes)[key]
    schema = f"query_id {dict(queries.dtypes)[key]}, key {kind}, score double"
    known = _usable(rows, key, vector)
    found = rows.sparkSession.createDataFrame([], schema)
    if metric != "inner" and size["n"] and size["widest"] <= 16 + 8 * SHORT and asked.select(F.size("v")).distinct().count() == 1:
        return _by_stretches(asked, known, k, metric, itself, schema).select("query_id", F.col("key").alias(key), "score")
    blocks = 1 + (size["bytes"] or 0) // block_bytes if size["n"] else 0
    for b in range(blocks):
        found = found.unionByName(_block(asked.where(F.pmod(F.xxhash64("key", "v"), F.lit(blocks)) == b), known, k, metric, itself, schema))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return found.withColumn("_r", rank).where(F.col("_r") <= k).select("query_id", F.col("key").alias(key), "score")


def _block(asked: DataFrame, known: DataFrame, k: int, metric: str, itself: bool, schema: str) -> DataFrame:
    """The k best rows of each query of one block, from each task."""
    told = asked.collect()
    by_length: dict[int, list] = {}
    for r in told:
        by_length.setdefault(len(r["v"]), []).append(r)
    packed = {n: (np.array([r["key"] for r in some]), np.array([r["v"] for r in some], float).reshape(len(some), n)) for n, some in by_length.items()}
    shared = known.sparkSession.sparkContext.broadcast(packed)

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, pd.DataFrame] = {}
        # the score that a row must reach: the worst of a query's best so far, once it has k
        worst = {n: np.full(len(names), -np.inf) for n, (names, _) in shared.value.items()}
        for f in frames:
            lengths = f["v"].map(len)
            for n, (names, q) in shared.value.items():
                some = f[lengths == n]
                step = max(64, 4_000_000 // len(q))
                for at in range(0, len(some), step):
                    part = some.iloc[at : at + step]
                    keys = part["key"].to_numpy()
                    s = np.round(_scores(metric, q, np.stack(part["v"].to_numpy()).reshape(len(part), n)), DECIMALS) + 0.0
                    if not itself:
                        s = np.where(names[:, None] == keys[None, :], -np.inf, s)
                    floor = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(q), -np.inf)
                    i, j = np.nonzero((s >= np.maximum(floor, worst[n])[:, None]) & (s > -np.inf))
                    if not len(i):
                        continue
                    met = pd.DataFrame({"q": i, "key": keys[j], "score": s[i, j]})
                    best[n] = _best(pd.concat([best[n], met]) if n in best else met, k)
                    full = best[n].groupby("q")["score"].agg(["size", "min"]).query("size >= @k")
                    worst[n][full.index.to_numpy()] = full["min"].to_numpy()
        for n, rows in best.items():
            names = shared.value[n][0]
            yield pd.DataFrame({"query_id": names[rows["q"].to_numpy()], "key": rows["key"].to_numpy(), "score": rows["score"].to_numpy()})

    return known.mapInPandas(meet, schema)


def _by_stretches(asked: DataFrame, known: DataFrame, k: int, metric: str, itself: bool, schema: str) -> DataFrame:
    """query_id, key and score of the k nearest rows, of short vectors of one length: two meetings of queries and rows by stretches of a coordinate.

    No coordinate of two vectors (scaled to length 1 for cosine) differs by more than their distance. The first meeting tells
    how near the k-th row of a query's own stretch is, the second asks all stretches within that distance.
    """
    shipped(asked.sparkSession)
    wide = asked.select(F.size("v")).first()[0]
    known = known.where(F.size("v") == wide)
    # of equal vectors only the smallest keys can be among the nearest, and a query's own
    least = F.dense_rank().over(Window.partitionBy("v").orderBy("key"))
    rows = known.withColumn("_r", least).where(F.col("_r") <= k + 1).drop("_r")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    at = lambda i: F.when(length > 0, F.get("v", F.lit(i)) / length).otherwise(0.0) if metric == "cosine" else F.get("v", F.lit(i))
    told = kept(rows.withColumns({f"_{i}": at(i) for i in range(wide)}))
    spread = told.agg(F.count("*").alias("n"), *[F.var_pop(f"_{i}").alias(f"_{i}") for i in range(wide)]).first()
    axis = max(range(wide), key=lambda i: spread[f"_{i}"] or 0.0)
    parts = max(1, -(-spread["n"] // STRETCH))
    bounds = np.array(sorted(set(told.approxQuantile(f"_{axis}", [i / parts for i in range(1, parts)], 1 / (4 * parts))))) if parts > 1 else np.zeros(0)
    stretch = F.pandas_udf(lambda x: pd.Series(np.searchsorted(bounds, x.to_numpy(), side="right").astype(np.int64)), "long")
    placed = kept(told.select("key", "v", stretch(F.col(f"_{axis}")).alias("b")))
    # rows alike in that coordinate are dealt out
    pieces = placed.groupBy("b").agg((1 + F.floor(F.count("*") / HELD)).cast("int").alias("pieces"))
    held = placed.join(F.broadcast(pieces), "b").withColumn("p", F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int"))
    here = asked.withColumn("x", at(axis)).withColumn("n", F.monotonically_increasing_id())
    here = kept(here)

    def meet(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(m):
            keys, names, v = m["key"].to_numpy(), q["key"].to_numpy(), np.stack(m["v"].to_numpy())
            step = max(1, 4_000_000 // len(m))
            for first in range(0, len(q), step):
                some = q.iloc[first : first + step]
                s = np.round(_scores(metric, np.stack(some["v"].to_numpy()), v), DECIMALS) + 0.0
                if not itself:
                    s = np.where(names[first : first + step, None] == keys[None, :], -np.inf, s)
                floor = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(some), -np.inf)
                i, j = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
                best = _best(pd.DataFrame({"q": i, "key": keys[j], "score": s[i, j]}), k)
                found.append(pd.DataFrame({"n": some["n"].to_numpy()[best["q"]], "query_id": some["key"].to_numpy()[best["q"]], "key": best["key"].to_numpy(), "score": best["score"].to_numpy()}))
        return pd.concat(found) if found else pd.DataFrame({"n": np.zeros(0, np.int64), "query_id": [], "key": [], "score": np.zeros(0)})

    def met(queries: DataFrame) -> DataFrame:
        dealt = queries.join(F.broadcast(pieces), "b").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        both = dealt.select("b", "p", "n", "key", "v").groupBy("b", "p").cogroup(held.groupBy("b", "p"))
        found = both.applyInPandas(meet, f"n long, {schema}")
        return found.withColumn("_r", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "key"))).where(F.col("_r") <= k)

    own = met(here.withColumn("b", stretch("x"))).groupBy("n").agg(F.count("*").alias("found"), F.min("score").alias("worst"))
    # half a unit of the last decimal on either side, and as much for sums in another order
    slack = 2.0 * 10.0**-DECIMALS
    far = F.sqrt(F.greatest(2 - 2 * F.col("worst"), F.lit(0.0)) + 2 * slack) if metric == "cosine" else -F.col("worst") + slack + F.abs("worst") * 1e-12
    reach = F.when(F.col("found") >= k, far).otherwise(F.lit(float("inf")))
    asks = here.join(own, "n", "left").withColumn("far", F.coalesce(reach, F.lit(float("inf"))))
    asks = asks.withColumn("b", F.explode(F.sequence(stretch(F.col("x") - F.col("far")), stretch(F.col("x") + F.col("far")))))
    # queries of one key share one list
    last = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return met(asks).withColumn("_r", last).where(F.col("_r") <= k)
