"""Connected components of links by alternating star contraction, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import kept


#: A key with more than this part of all rows is met by a broadcast.
HOT = 1000


def _met(links: DataFrame, minima: DataFrame, n: int) -> DataFrame:
    """links joined with the minimum of their u; minima: u, m, times (rows of that u)."""
    most = max(1, n / HOT)
    hubs, rest = (minima.where(c).drop("times") for c in (F.col("times") > most, F.col("times") <= most))
    first = links.join(F.broadcast(hubs), "u", "left")
    return first.where("m IS NOT NULL").unionByName(first.where("m IS NULL").drop("m").join(rest.hint("merge"), "u"))


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node of links (a, b).

    Each round hangs every node's larger neighbours, then its smaller ones, under its
    smallest neighbour, until nothing changes; rounds grow with the logarithm of a
    component's diameter. Minima are pre-aggregated before each shuffle, and hubs, the
    nodes with more than a thousandth of all links (so a thousand at most), meet their
    links by a broadcast: a component of a third of all nodes is no hot key.
    """
    edges = kept(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before, n = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("times")).select("u", F.least("u", "m").alias("m"), "times")
        large = _met(both.where("v > u"), least, 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("times"))
        small = _met(large, low, 2 * n).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = kept(small.where("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, n = state, state[0]
    found = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
