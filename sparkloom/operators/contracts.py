"""Decision contracts: predicates on a bundle of results, built as columns, and what happens when they hold."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def predicate(value: Column, kind: str, op: str, operand: Any) -> Column:
    """Whether `value` (of kind number, text or list) stands in relation `op` to the operand; false where types don't fit or the value is null.

    Operators: == != > >= < <= in not_in contains regex. != and not_in hold for nulls.
    """
    if op in ("==", "!="):
        same = F.coalesce(value.eqNullSafe(F.lit(operand)), F.lit(False)) if (kind == "number") == isinstance(operand, (int, float)) else F.lit(False)
        return same if op == "==" else ~same
    if op in ("in", "not_in"):
        fits = isinstance(operand, (list, tuple, set))
        inside = F.coalesce(value.isin(*operand), F.lit(False)) if fits and operand else F.lit(False)
        return inside if op == "in" else (~inside if fits else F.lit(False))
    if op == "contains":
        found = F.array_contains(value, operand) if kind == "list" else value.contains(str(operand)) if kind == "text" else F.lit(False)
        return F.coalesce(found, F.lit(False))
    if op == "regex":
        return F.coalesce(value.rlike(operand), F.lit(False)) if kind == "text" else F.lit(False)
    number = value.cast("double") if kind == "number" else value.try_cast("double") if kind == "text" else F.lit(None).cast("double")
    compared = {">": number > operand, ">=": number >= operand, "<": number < operand, "<=": number <= operand}[op]
    return F.coalesce(compared, F.lit(False))


def evaluated(bundles: DataFrame, contracts: list[tuple[str, Column, str, str, Any]], carried: list[str]) -> DataFrame:
    """contract, satisfied and value (as text) of each contract (name, field, kind, op, operand) on each bundle."""
    told = [F.struct(F.lit(n).alias("contract"), predicate(f, kind, op, x).alias("satisfied"), (F.array_join(f, ",") if kind == "list" else f.cast("string")).alias("value")) for n, f, kind, op, x in contracts]
    return bundles.select(*carried, F.inline(F.array(*told)))


def fired(decisions: DataFrame, at: str, seconds: int, most: int, keys: list[str], order: list[str], dry_run: bool = False) -> DataFrame:
    """outcome of each decision: not_satisfied, rate_limited (more than `most` satisfied ones within `seconds`), dry_run or fired."""
    time, reach = F.unix_micros(at), seconds * 1_000_000
    # stretches of time, so that no task holds all of a key; what can count in the next stretch is lent to it
    wide = 4 * reach
    slice_ = F.floor(time / wide)
    lent = decisions.where(F.col("satisfied") & (F.pmod(time, F.lit(wide)) > wide - reach)).withColumns({"_slice": slice_ + 1, "_own": F.lit(False)})
    cut = decisions.withColumns({"_slice": slice_, "_own": F.lit(True)}).unionByName(lent)
    span = Window.partitionBy(*keys, "_slice").orderBy(time).rangeBetween(-reach + 1, 0)
    recent = F.count_if("satisfied").over(span)
    outcome = F.when(~F.col("satisfied"), "not_satisfied").when(F.col("_recent") > most, "rate_limited").otherwise("dry_run" if dry_run else "fired")
    return cut.withColumn("_recent", recent).where("_own").withColumn("outcome", outcome).drop("_recent", "_slice", "_own")


def entry_errors(entries: DataFrame) -> DataFrame:
    """The entries with errors and warnings, and quarantined where there is an error.

    id, name, source and license must be there, a definition has eight signs at least,
    the status is a known one and the score lies between 0 and 1.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    errors = [F.when(blank(c), f"missing_{c}") for c in ("id", "name", "source", "license")]
    errors += [F.when(F.length(F.coalesce("definition", F.lit(""))) < 8, "short_definition"), F.when(~F.coalesce(F.col("score").between(0, 1), F.lit(True)), "score_out_of_range")]
    warnings = [F.when(~F.coalesce(F.col("status").isin("draft", "reviewed", "canonical", "deprecated"), F.lit(False)), "unknown_status"), F.when(F.size(F.coalesce("aliases", F.array().cast("array<string>"))) == 0, "no_aliases")]
    judged = entries.withColumns({"errors": F.array_compact(F.array(*errors)), "warnings": F.array_compact(F.array(*warnings))})
    return judged.withColumn("quarantined", F.size("errors") > 0)


def projected_bands(bands: DataFrame, low: float | None, high: float | None) -> DataFrame:
    """Rows of low, value and high clamped into bounds, with whether any of them was moved."""
    names = ("low", "value", "high")
    clip = lambda c: F.greatest(F.lit(low), F.least(F.lit(high), F.col(c))) if low is not None and high is not None else F.greatest(F.lit(low), F.col(c)) if low is not None else F.least(F.lit(high), F.col(c)) if high is not None else F.col(c)
    moved = F.greatest(*[(clip(c) != F.col(c)).cast("int") for c in names]) == 1
    return bands.withColumn("clipped", moved).withColumns({c: clip(c) for c in names})


def template_scores(columns: DataFrame, templates: DataFrame, cadence: str) -> DataFrame:
    """score of each template: share of its keywords that some column's name holds, halved for another cadence, weighed by how much of its range the columns overlap.

    columns: name, lo, hi. templates: template, keyword, cadence, lo, hi (a row for each keyword).
    Columns and keywords are metadata of one table, a few hundred rows at most.
    """
    met = templates.join(F.broadcast(columns.withColumnRenamed("lo", "clo").withColumnRenamed("hi", "chi")), F.expr("contains(lower(name), keyword)"), "left")
    overlap = F.greatest(F.lit(0.0), F.least("hi", "chi") - F.greatest("lo", "clo")) / F.greatest(F.col("chi") - F.col("clo"), F.lit(1e-9))
    each = met.groupBy("template", "keyword", "cadence").agg(F.count("name").alias("n"), F.max(F.when(F.col("name").isNotNull(), F.least(F.lit(1.0), overlap))).alias("overlap"))
    told = each.groupBy("template", "cadence").agg(F.avg((F.col("n") > 0).cast("int")).alias("hit"), F.coalesce(F.avg("overlap"), F.lit(0.0)).alias("overlap"))
    return told.select("template", (F.col("hit") * F.when(F.col("cadence") == cadence, 1.0).otherwise(0.5) * (0.5 + 0.5 * F.col("overlap"))).alias("score"))
