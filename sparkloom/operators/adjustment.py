"""Causal adjustment on a graph: which columns to hold so that an effect can be told, the effect, and what would have been.

A graph is a table of edges (source, target, and weight where cycles are to be broken). Whether
nodes are separated is found by a frontier of (node, direction) pairs that grows by joins until
nothing is new, so graphs need fit no task; sets of names that come to the driver are those of
columns of a table.

Statuses: IDENTIFIED, UNIDENTIFIABLE (no set blocks every back door), UNKNOWN_NODE, TOO_FEW_ROWS
(fewer complete rows than 8 and than the terms and 2 more).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.lineage import kept

from . import estimates

EFFECT = "status string, adjustment array<string>, effect double, se double, n long, predicted double"


def _names(df: DataFrame, values) -> DataFrame:
    return df.sparkSession.createDataFrame([(v,) for v in sorted(values)], "node string")


def _arcs(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target")).dropna().where("source <> target").distinct()


def _grown(frontier: DataFrame, step) -> DataFrame:
    """All rows that steps from `frontier` reach, itself included."""
    seen = new = kept(frontier.distinct())
    while not new.isEmpty():
        new = kept(step(new).distinct().join(seen, seen.columns, "left_anti"))
        seen = kept(seen.unionByName(new))
    return seen


def ancestors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node: the given nodes and all from which a path leads to one of them."""
    arcs = kept(_arcs(edges))
    return _grown(nodes.select("node"), lambda f: f.join(arcs, f["node"] == arcs["target"]).select(F.col("source").alias("node")))


def descendants(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node: the given nodes and all to which a path leads from one of them."""
    return ancestors(edges.select(F.col("source").alias("target"), F.col("target").alias("source")), nodes)


def connected(edges: DataFrame, node: str, given=()) -> DataFrame:
    """node: those that `node` is connected to, given the others: a path leads there that no given node blocks, and whose colliders are given or have a given descendant."""
    arcs = kept(_arcs(edges))
    held = _names(edges, given)
    above = kept(ancestors(arcs, held).withColumn("opens", F.lit(True)))
    held = kept(held.withColumn("held", F.lit(True)))
    start = edges.sparkSession.createDataFrame([(node, True)], "node string, up boolean")

    def step(f: DataFrame) -> DataFrame:
        told = f.join(F.broadcast(held), "node", "left").join(above, "node", "left")
        free = F.col("held").isNull()
        # from a child on to parents and children; from a parent on to children, or back to parents where a collider is open
        down = told.where(free).join(arcs, told["node"] == arcs["source"]).select(F.col("target").alias("node"), F.lit(False).alias("up"))
        back = told.where((F.col("up") & free) | (~F.col("up") & F.col("opens").isNotNull()))
        return down.unionByName(back.join(arcs, back["node"] == arcs["target"]).select(F.col("source").alias("node"), F.lit(True).alias("up")))

    return _grown(start, step).select("node").distinct().join(held, "node", "left_anti").where(F.col("node") != node)


def separated(edges: DataFrame, a: str, b: str, given=()) -> bool:
    """Whether the given nodes separate a from b."""
    return connected(edges, a, given).where(F.col("node") == b).isEmpty()


def acyclic(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges without the weakest one of each cycle, and those that were dropped, in the order of their weights."""
    left = kept(edges.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), F.col("weight").cast("double").alias("weight")).where("source <> target").groupBy("source", "target").agg(F.max("weight").alias("weight")))
    dropped = left.limit(0)
    while True:
        # what can't be on a cycle is peeled off, until only edges between nodes with ways in and out are left
        core, n = left, -1
        while (now := core.count()) != n:
            n = now
            ins, outs = core.select(F.col("target").alias("source")).distinct(), core.select(F.col("source").alias("target")).distinct()
            core = kept(core.join(ins, "source", "left_semi").join(outs, "target", "left_semi").select("source", "target", "weight"))
        if not n:
            return left, dropped
        weakest = None
        for e in core.orderBy("weight", "source", "target").toLocalIterator():
            if not descendants(core, _names(edges, [e["target"]])).where(F.col("node") == e["source"]).isEmpty():
                weakest = e
                break
        gone = edges.sparkSession.createDataFrame([tuple(weakest[c] for c in ("source", "target", "weight"))], "source string, target string, weight double")
        dropped = kept(dropped.unionByName(gone))
        left = kept(left.join(gone, ["source", "target"], "left_anti"))


def blocks(edges: DataFrame, treatment: str, outcome: str, given) -> bool:
    """Whether `given` holds no descendant of the treatment and blocks all its back doors to the outcome."""
    below = descendants(edges, _names(edges, [treatment]))
    if not below.join(_names(edges, given), "node", "left_semi").isEmpty():
        return False
    return separated(_arcs(edges).where(F.col("source") != treatment), treatment, outcome, given)


def adjustment_set(edges: DataFrame, treatment: str, outcome: str, nodes: DataFrame | None = None) -> tuple[str, list[str]]:
    """Status, and the columns to hold: the treatment's parents if they block every back door, else all its ancestors (without the outcome) if they do. `nodes`: those without edges."""
    every = edges.selectExpr("explode(array(source, target)) AS node")
    every = every.unionByName(nodes.select("node")) if nodes is not None else every
    if len({r["node"] for r in every.where(F.col("node").isin(treatment, outcome)).distinct().collect()}) < len({treatment, outcome}):
        return "UNKNOWN_NODE", []
    below = descendants(edges, _names(edges, [treatment]))
    parents = _arcs(edges).where(F.col("target") == treatment).select(F.col("source").alias("node"))
    above = ancestors(edges, _names(edges, [treatment])).where(~F.col("node").isin(treatment, outcome))
    for found in (parents, above):
        given = sorted(r["node"] for r in found.distinct().join(below, "node", "left_anti").collect())
        if outcome not in given and blocks(edges, treatment, outcome, given):
            return "IDENTIFIED", given
    return "UNIDENTIFIABLE", []


def effect(df: DataFrame, edges: DataFrame, treatment: str, outcome: str, value: float | None = None, also=(), nodes: DataFrame | None = None) -> DataFrame:
    """status, adjustment, effect (of one unit of the treatment on the outcome), se, n and predicted (the mean outcome if the treatment were `value`): a regression on complete rows that holds the adjustment set and `also`."""
    status, held = adjustment_set(edges, treatment, outcome, nodes)
    held = [*held, *[c for c in also if c not in held]]
    tell = lambda *row: df.sparkSession.createDataFrame([row], EFFECT)
    if status != "IDENTIFIED":
        return tell(status, None, None, None, None, None)
    rows = df.select(treatment, outcome, *held).dropna()
    means = rows.agg(F.count("*").alias("n"), F.avg(treatment).alias("x"), F.avg(outcome).alias("y")).first()
    if means["n"] < max(8, len(held) + 2):
        return tell("TOO_FEW_ROWS", held, None, None, means["n"], None)
    slope = estimates.ols(rows, outcome, [treatment, *held]).where(F.col("term") == treatment).first()
    predicted = None if value is None else float(means["y"] + slope["estimate"] * (value - means["x"]))
    return tell(status, held, float(slope["estimate"]), float(slope["se"]), means["n"], predicted)


def counterfactual(df: DataFrame, edges: DataFrame, treatment: str, outcome: str, value: Column, also=(), nodes: DataFrame | None = None) -> DataFrame:
    """The rows with cf_treatment (`value`), cf_outcome and delta: the outcome with what isn't explained by the treatment left as it was (linear, additive noise). Null where the effect can't be told."""
    told = effect(df, edges, treatment, outcome, None, also, nodes).first()
    delta = F.lit(told["effect"]).cast("double") * (value.cast("double") - F.col(treatment))
    return df.withColumns({"cf_treatment": value.cast("double"), "delta": delta, "cf_outcome": F.col(outcome) + delta})


def mean_counterfactual(df: DataFrame, edges: DataFrame, treatment: str, outcome: str, value: float, **options) -> DataFrame:
    """observed_treatment, observed_outcome, cf_outcome and delta of the mean row."""
    means = df.agg(F.avg(treatment).alias(treatment), F.avg(outcome).alias(outcome))
    told = effect(df, edges, treatment, outcome, None, **options).first()
    delta = F.lit(told["effect"]).cast("double") * (F.lit(float(value)) - F.col(treatment))
    return means.select(F.col(treatment).alias("observed_treatment"), F.col(outcome).alias("observed_outcome"), (F.col(outcome) + delta).alias("cf_outcome"), delta.alias("delta"))
