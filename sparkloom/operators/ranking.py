"""Ranking of findings against a question, and sorting of rows by several figures at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import jaccard
from sparkloom.lineage import kept
from sparkloom.packaging import shipped

#: Weights of the parts of each score, least scores and lengths of the two lists.
RELEVANCE = {"keyword": 0.40, "kind": 0.25, "confidence": 0.15, "referent": 0.10, "severity": 0.10}
SURPRISE = {"significance": 0.40, "unusualness": 0.25, "contradiction": 0.20, "novelty": 0.10, "confidence": 0.05}
LISTS = {"relevant": (0.30, 8), "surprise": (0.50, 5)}
#: Words that stand for a kind of finding.
KINDS = {
    "anomaly": "anomaly outlier spike weird unusual off abnormal".split(),
    "regime": "regime shift phase transition change switch".split(),
    "forecast": "forecast predict projection next future upcoming ahead trajectory".split(),
    "physics_match": "law model fit rule equation relationship principle".split(),
    "causal": ["effect", "cause", "impact", "drive", "lead to", "because", "result"],
}
#: Words without weight.
STOP = "the a an is are was were be been being of in on at to for and or but with what any do does did have has i we you they he she it want need look see find show data dataset".split()
#: Words of calm and of change.
CALM = "stable steady consistent calm normal baseline typical".split()
CHANGE = "shift change regime anomaly spike break outlier transition".split()
#: Weights of severities and of what became of a finding.
SEVERITY = {"crit": 1.0, "warn": 0.7, "info": 0.4, "ok": 0.2}
NOVELTY = {"novel": 1.0, "strengthened": 0.5, "confirmed": 0.3, "weakened": 0.2, "contradicted": 0.1, "pending": 0.4}


def words(text: Column, stop: list[str] | None = None) -> Column:
    """Runs of a-z and 0-9 in small letters; with stop words, without these and without single characters."""
    found = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(stop)) if stop is not None else found


def _valued(column: Column, values: dict[str, float], other: float) -> Column:
    return F.coalesce(reduce(lambda w, kv: w.when(column == kv[0], kv[1]), values.items(), F.when(F.lit(False), 0.0)), F.lit(other))


def _any(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts], F.lit(False))


def kind_of(title: Column, method: Column) -> Column:
    """What a finding tells of, by its title and method."""
    t, m = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(method, F.lit("")))
    return (
        F.when(_any(t, ["anomaly"]) | _any(m, ["iso-forest", "iso forest"]), "anomaly")
        .when(t.startswith("forecast") | m.contains("forecast"), "forecast")
        .when(t.contains("regime") | m.contains("regime"), "regime")
        .when(_any(t, ["matches known law", "physical model fit"]) | m.contains("physics_prior"), "physics_match")
        .when(t.contains("causal") | m.contains("causal"), "causal")
        .otherwise("generic")
    )


def _asked(question: str) -> tuple[list[str], list[str], list[str]]:
    """Words of the question, those with the words of the kinds it names, and these kinds."""
    import re

    own = [w for w in re.findall("[a-z0-9]+", question.lower()) if len(w) > 1 and w not in STOP]
    wide = list(own)
    for kind, told in KINDS.items():
        if set(told) & set(own):
            wide += [kind, *told]
    return own, wide, [kind for kind, told in KINDS.items() if (set(told) | {kind}) & set(wide)]


def _array(found: list[str]) -> Column:
    return F.array(*map(F.lit, found)) if found else F.array().cast("array<string>")


def scored(findings: DataFrame, question: str, template: str | None = None) -> DataFrame:
    """findings (title, description, method, confidence, severity, label, z, score, status; nulls allowed) with `relevance` to the question and `surprise` beside it.

    Relevance weighs the Jaccard index of words (the question's widened by the words of the kinds it names;
    without a common word 0.15 if one of its words is part of the finding's text), the kind, the confidence, the
    label (1 if the question has it, 0.7 for a word of it, 0.5 for a named template) and the severity.
    Surprise weighs z or score over 5 (else the severity), 1 less the relevance, a change where the question
    speaks of calm or the reverse (1, else 0.3), novelty and confidence. Columns that are not there count as null.
    """
    kinds = dict.fromkeys("title description method severity label status".split(), "string") | dict.fromkeys("confidence z score".split(), "double")
    c = {n: F.col(n).cast(t) if n in findings.columns else F.lit(None).cast(t) for n, t in kinds.items()}
    own, wide, named = _asked(question)
    text = F.concat_ws(" ", *[F.coalesce(c[n], F.lit("")) for n in ("title", "description", "method")])
    told = words(text, STOP)
    shared = jaccard(F.array_distinct(told), F.array_distinct(_array(wide)))
    keyword = F.when(shared > 0, shared).when(_any(F.array_join(told, " "), own) if own else F.lit(False), 0.15).otherwise(0.0)
    label = F.lower(F.coalesce(c["label"], F.lit("")))
    plain = _array(_plain_words(question))
    asked = F.lit(question.lower())
    referent = F.when((label != "") & F.contains(asked, label), 1.0).when(F.arrays_overlap(words(label), plain), 0.7).otherwise(0.5 if template and template in question.lower() else 0.0)
    confidence, severity = F.coalesce(c["confidence"], F.lit(0.0)), _valued(F.coalesce(c["severity"], F.lit("info")), SEVERITY, 0.3)
    kind = F.when(kind_of(c["title"], c["method"]).isin(named), 1.0).otherwise(0.0) if named else F.lit(0.0)
    parts = {"keyword": keyword, "kind": kind, "confidence": confidence, "referent": referent, "severity": severity}
    relevance = sum((RELEVANCE[n] * x for n, x in parts.items()), F.lit(0.0))
    title = F.lower(F.coalesce(c["title"], F.lit("")))
    against = (_any(title, CHANGE) & F.lit(bool(set(CALM) & set(own)))) | (_any(title, CALM) & F.lit(bool(set(CHANGE) & set(own))))
    # least() passes over nulls, so the figure is chosen first
    figure = F.coalesce(c["z"], c["score"])
    size = F.when(figure.isNotNull(), F.least(F.lit(1.0), F.abs(figure) / 5)).otherwise(severity)
    rest = {"significance": size, "unusualness": F.greatest(F.lit(0.0), 1 - F.col("relevance")), "contradiction": F.when(against, 1.0).otherwise(0.3), "novelty": _valued(c["status"], NOVELTY, 0.3), "confidence": confidence}
    return findings.withColumn("relevance", relevance).withColumn("surprise", sum((SURPRISE[n] * x for n, x in rest.items()), F.lit(0.0)))


def _plain_words(question: str) -> list[str]:
    import re

    return re.findall("[a-z0-9]+", question.lower())


def two_lists(findings: DataFrame, question: str, key: str, template: str | None = None) -> DataFrame:
    """list (relevant or surprise), rank, key and score: the most relevant findings, and the most surprising of the others; nothing for an empty question. Ties to the smaller key."""
    told = scored(findings, question, template).select(F.col(key).alias("key"), F.round("relevance", 9).alias("relevance"), F.round("surprise", 9).alias("surprise"))
    if not question.strip():
        return told.where(F.lit(False)).select(F.lit("").alias("list"), F.lit(0).alias("rank"), "key", F.col("relevance").alias("score"))
    (least, most), (surprising, few) = LISTS["relevant"], LISTS["surprise"]
    first = told.where(F.col("relevance") >= least).orderBy(F.desc("relevance"), "key").limit(most)
    # at most `most` of the surprising findings stand in the first list: so many more are looked at
    second = told.where(F.col("surprise") >= surprising).orderBy(F.desc("surprise"), "key").limit(few + most).join(F.broadcast(first.select("key")), "key", "left_anti")
    lists = None
    for name, some, score, size in (("relevant", first, "relevance", most), ("surprise", second, "surprise", few)):
        packed = some.agg(F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("s"), "key"))).alias("l"))
        one = packed.select(F.posexplode(F.slice("l", 1, size)).alias("p", "x")).select(F.lit(name).alias("list"), (F.col("p") + 1).alias("rank"), F.col("x.key").alias("key"), (-F.col("x.s")).alias("score"))
        lists = one if lists is None else lists.unionByName(one)
    return lists


def weighted(figures: list[str], weights: dict[str, float], minimise: bool = True) -> Column:
    """One figure of several: their weighted mean (equal weights if all are 0), its sign turned if large is good."""
    w = [weights.get(f, 0.0) for f in figures]
    w = w if any(w) else [1.0] * len(w)
    total = sum((F.col(f) * (x / sum(w)) for f, x in zip(figures, w, strict=True)), F.lit(0.0))
    return total if minimise else -total


def _undominated(points: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether no row of `among` is at least as large in every figure as a point and larger in one; in pieces of bounded size."""
    keep = np.ones(len(points), bool)
    for at in range(0, len(among), 256):
        some = among[at : at + 256]
        for i in range(0, len(points), 2048):
            left = np.nonzero(keep[i : i + 2048])[0] + i
            p = points[left]
            beaten = (some[None, :, :] >= p[:, None, :]).all(axis=2) & (some[None, :, :] > p[:, None, :]).any(axis=2)
            keep[left[beaten.any(axis=1)]] = False
    return keep


def _front(points: DataFrame, figures: list[str], block: int) -> DataFrame:
    """The distinct figures that no others beat. First each task drops what its own rows beat; the few left are
    then compared block by block, each pair of blocks in a task of its own, so that a front of any size fits."""
    schema = ", ".join(f"{f} double" for f in figures)

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for f in frames:
            some = f[figures].to_numpy(float)
            some = some[np.argsort(-some.sum(axis=1), kind="stable")]
            some = some[_undominated(some, some[:512])]
            if best is not None:
                some = some[_undominated(some, best)]
                best = best[_undominated(best, some)]
            some = some[_undominated(some, some)]
            best = some if best is None else np.concatenate([best, some])
            while len(best) >= block:
                yield pd.DataFrame(best[:block], columns=figures)
                best = best[block:]
        if best is not None:
            yield pd.DataFrame(best, columns=figures)

    left = kept(points.mapInPandas(local, schema).distinct())
    blocks = 1 + left.count() // block
    if blocks == 1:
        return left.coalesce(1).mapInPandas(local, schema)
    dealt = left.withColumn("_b", F.pmod(F.xxhash64(*figures), F.lit(blocks)).cast("int"))
    pairs = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    others = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"), F.col("_b").alias("_o"), *figures)

    def beaten(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        gone = ~_undominated(a[figures].to_numpy(float), b[figures].to_numpy(float))
        return a.loc[gone, figures].astype(float)

    lost = pairs.groupBy("_b", "_o").cogroup(others.groupBy("_b", "_o")).applyInPandas(beaten, schema).distinct()
    return left.join(lost, figures, "left_anti")


def levels(df: DataFrame, key: str, figures: list[str], most: int = 3, minimise: bool = False, block: int = 20_000) -> DataFrame:
    """key and level (1: the front) of the first `most` levels of rows that no row of the same or a later level beats in any number of figures.

    Rows of equal figures share a level; rows with a null or undefined figure have none. Every level is one pass over
    the distinct figures that are left.
    """
    shipped(df.sparkSession)
    sign = -1.0 if minimise else 1.0
    rows = df.select(F.col(key).alias("key"), *[(F.col(f).cast("double") * sign).alias(f) for f in figures]).where(reduce(lambda a, b: a & b, [F.col(f).isNotNull() & ~F.isnan(f) for f in figures]))
    rest, out = kept(rows.select(*figures).distinct()), None
    for level in range(1, most + 1):
        front = kept(_front(rest, figures, block)).withColumn("level", F.lit(level))
        out = front if out is None else out.unionByName(front)
        if level < most:
            rest = kept(rest.join(front, figures, "left_anti"))
    return rows.join(out, figures).select("key", "level")
