"""Checks before an analysis: why values are missing, which values break a column's type, how a series is sampled.

Each check is a few aggregations over all rows. Positions come from an order key, and
runs of missing values from windows within slices of the order, never one global sort
in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .profile import value_type

#: Shares and sizes at which a pattern of missing values gets its name.
NEGLIGIBLE, NEAR_TOTAL, EDGE, CROWDED, TIMES, BLOCK, BLOCK_SHARE = 0.01, 0.80, 0.20, 0.5, 3.0, 5, 0.5
#: Resampling steps by the longest median gap in seconds.
STEPS = ((1, "1s"), (60, "1min"), (300, "5min"), (900, "15min"), (3600, "1h"), (21600, "6h"), (86400, "1D"), (604800, "7D"))


def _leading(text: Column) -> Column:
    """The first six bytes of a text as a number, in the order of texts."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")


def numbered(df: DataFrame, order: list[str], parts: int = 64) -> DataFrame:
    """pos (from 0 in the order) and total of each row: counts of ranges of the first order column are few, rows are numbered within them."""
    kind = dict(df.dtypes)[order[0]]
    first = F.unix_seconds(F.col(order[0]).cast("timestamp")) if kind.startswith(("timestamp", "date")) else F.col(order[0]) if kind in ("bigint", "int", "double") else _leading(F.col(order[0])) if kind == "string" else F.lit(0)
    bounds = df.select(first.alias("o")).stat.approxQuantile("o", [i / parts for i in range(1, parts)], 0.01)
    part = reduce(lambda a, b: a + b, [(first > b).cast("int") for b in sorted(set(bounds))], F.lit(0))
    cut = df.withColumn("_part", F.coalesce(part, F.lit(0)))  # nulls come first
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return cut.withColumn("_i", inside).join(F.broadcast(before), "_part").withColumn("pos", F.col("_i") + F.col("_before")).drop("_part", "_i", "_before")


def runs(marked: DataFrame, keys: list[str], slice_rows: int = 100_000) -> DataFrame:
    """first, last and length of maximal runs of equal steps of pos (rows of keys and pos), joined over slices of the positions."""
    cut = marked.select(*keys, "pos", F.floor(F.col("pos") / slice_rows).alias("_s"))
    island = F.col("pos") - F.row_number().over(Window.partitionBy(*keys, "_s").orderBy("pos"))
    pieces = cut.withColumn("_g", island).groupBy(*keys, "_s", "_g").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    w = Window.partitionBy(*keys).orderBy("a")
    starts = pieces.withColumn("_new", F.coalesce(F.lag("b").over(w) + 1 != F.col("a"), F.lit(True)).cast("int"))
    return starts.withColumn("_run", F.sum("_new").over(w)).groupBy(*keys, "_run").agg(F.min("a").alias("first"), F.max("b").alias("last")).withColumn("length", F.col("last") - F.col("first") + 1).drop("_run")


def missingness(df: DataFrame, columns: list[str], order: list[str], at: str | None = None) -> DataFrame:
    """column, n_missing, rate, pattern and severity of each column.

    Patterns: none, negligible, near_total, bulk_leading, bulk_trailing, time_correlated
    (by hour or weekday, where a time is given), structured (in blocks) and random.
    """
    rows = numbered(df, order)
    head = F.greatest(F.floor(F.col("total") * EDGE), F.lit(1))
    flags = [F.struct(F.lit(c).alias("column"), F.col(c).isNull().alias("gone")) for c in columns]
    time = [F.hour(at).alias("hour"), F.weekday(at).alias("weekday")] if at else [F.lit(0).alias("hour"), F.lit(0).alias("weekday")]
    long = rows.select("pos", "total", head.alias("head"), *time, F.inline(F.array(*flags)))
    # one pre-aggregated table of few rows serves the counts, the edges and the hours
    zone = F.when(F.col("pos") < F.col("head"), "head").when(F.col("pos") >= F.col("total") - F.col("head"), "tail").otherwise("middle")
    cube = long.groupBy("column", "hour", "weekday", zone.alias("zone")).agg(F.count("*").alias("n"), F.count_if("gone").alias("m"))
    rate = lambda z: F.sum(F.when(F.col("zone") == z, F.col("m"))) / F.sum(F.when(F.col("zone") == z, F.col("n")))
    whole = cube.groupBy("column").agg(F.sum("n").alias("n_total"), F.sum("m").alias("n_missing"), *[F.coalesce(rate(z), F.lit(0.0)).alias(z) for z in ("head", "middle", "tail")])
    swings = []
    for unit in ("hour", "weekday"):
        each = cube.groupBy("column", unit).agg((F.sum("m") / F.sum("n")).alias("r"))
        swings.append(each.groupBy("column").agg((F.max("r") - F.min("r")).alias(f"{unit}_spread"), F.max("r").alias(f"{unit}_top")))
    blocks = runs(long.where("gone"), ["column"]).where(F.col("length") >= BLOCK).groupBy("column").agg(F.sum("length").alias("in_blocks"))
    told = whole.join(swings[0], "column").join(swings[1], "column").join(blocks, "column", "left")
    share = F.col("n_missing") / F.col("n_total")
    crowded = lambda z: (F.col(z) > CROWDED) & (((F.col("middle") > 0) & (F.col(z) / F.greatest("middle", F.lit(1e-9)) >= TIMES)) | (F.col("middle") < 0.05))
    swing = lambda u: F.when((F.col(f"{u}_spread") > 0.2) & (F.col(f"{u}_top") > 2 * share) & (F.col(f"{u}_top") > 0.2), F.col(f"{u}_spread")).otherwise(0.0)
    pattern = (
        F.when(F.col("n_missing") == 0, "none")
        .when(share < NEGLIGIBLE, "negligible")
        .when(share > NEAR_TOTAL, "near_total")
        .when(crowded("head") & ~crowded("tail"), "bulk_leading")
        .when(crowded("tail") & ~crowded("head"), "bulk_trailing")
        .when(F.greatest(swing("hour"), swing("weekday")) >= 0.5, "time_correlated")
        .when(F.coalesce("in_blocks", F.lit(0)) / F.col("n_missing") >= BLOCK_SHARE, "structured")
        .otherwise("random")
    )
    named = told.select("column", "n_missing", share.alias("rate"), pattern.alias("pattern"))
    severity = F.when(F.col("pattern") == "near_total", "crit").when(F.col("rate") >= 0.2, "warn").otherwise("info")
    return named.withColumn("severity", F.when(F.col("pattern") == "none", F.lit(None)).otherwise(severity))


def type_violations(df: DataFrame, columns: list[str], key: str, dominance: float = 0.7, least: float = 0.001, samples: int = 5) -> DataFrame:
    """column, dominant type, n_other, rate, samples (values of other types, by their smallest keys) and severity.

    Integers and decimals vote as numbers. A column without a dominant type is mixed, and
    all its values count. Only columns whose rate reaches `least` are told.
    """
    number = lambda t: F.when(t.isin("integer", "float"), "number").otherwise(t)
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text")) for c in columns]
    long = df.select(F.col(key).alias("_k"), F.inline(F.array(*cells))).withColumn("type", number(value_type(F.col("text")))).where("type <> 'empty'")
    few = F.slice(F.sort_array(F.collect_list(F.struct("_k", "text"))), 1, samples)
    counts = long.groupBy("column", "type").agg(F.count("*").alias("n"))
    top = counts.groupBy("column").agg(F.sum("n").alias("filled"), F.max(F.struct("n", "type")).alias("top"))
    judged = top.select("column", "filled", F.when(F.col("top.n") >= dominance * F.col("filled"), F.col("top.type")).otherwise("mixed").alias("dominant"))
    other = counts.join(judged, "column").where("type <> dominant").groupBy("column", "dominant", "filled").agg(F.sum("n").alias("n_other"))
    rate = F.col("n_other") / F.col("filled")
    # the rank filter is pushed below the shuffle, so that a task of a column gets a few rows from each task before it
    ranked = F.row_number().over(Window.partitionBy("column").orderBy("_k", "text"))
    shown = long.join(F.broadcast(judged.select("column", "dominant")), "column").where("type <> dominant").withColumn("_r", ranked).where(F.col("_r") <= samples)
    shown = shown.groupBy("column").agg(F.transform(few, lambda x: x["text"]).alias("samples"))
    found = other.withColumn("rate", rate).where(F.col("rate") >= least).join(shown, "column", "left")
    return found.select("column", "dominant", "n_other", "rate", "samples", F.when(F.col("rate") >= 0.2, "crit").when(F.col("rate") >= 0.05, "warn").otherwise("info").alias("severity"))


def sampling(df: DataFrame, at: str, order: list[str], keys: list[str]) -> DataFrame:
    """Of each series: median, mean and largest gap in seconds, their coefficient of variation, gaps over ten medians, verdict and resampling step."""
    w = Window.partitionBy(*keys).orderBy(*order)
    time = F.col(at).cast("timestamp")
    gaps = df.withColumn("_gap", (F.unix_micros(time) - F.unix_micros(F.lag(time).over(w))) / 1e6).where("_gap IS NOT NULL")
    told = gaps.groupBy(*keys).agg(F.median("_gap").alias("median"), F.avg("_gap").alias("mean"), F.max("_gap").alias("largest"), F.stddev_pop("_gap").alias("_sd"))
    wide = gaps.join(told.select(*keys, "median"), keys).groupBy(*keys).agg(F.count_if(F.col("_gap") > 10 * F.col("median")).alias("n_wide"))
    cv = F.when(F.col("mean") > 0, F.col("_sd") / F.col("mean")).otherwise(0.0)
    verdict = F.when(F.col("n_wide") > 0, "gaps").when(F.col("cv") < 0.05, "regular").when(F.col("cv") < 0.5, "mild").otherwise("irregular")
    return told.withColumn("cv", cv).join(wide, keys).withColumn("verdict", verdict).withColumn("step", resample_step(F.col("median"))).drop("_sd")


def resample_step(seconds: Column) -> Column:
    found = F.when(seconds <= 0, F.lit(None).cast("string"))
    for limit, name in STEPS:
        found = found.when(seconds <= limit, name)
    return found.otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("D")))


def findings(missing: DataFrame, types: DataFrame, sampled: DataFrame) -> DataFrame:
    """check, subject, label and severity of all that the checks have to say."""
    a = missing.where("pattern <> 'none'").select(F.lit("missingness").alias("check"), F.col("column").alias("subject"), F.col("pattern").alias("label"), "severity")
    b = types.select(F.lit("schema").alias("check"), F.col("column").alias("subject"), F.col("dominant").alias("label"), "severity")
    c = sampled.where("verdict IN ('gaps', 'irregular')").select(F.lit("sampling").alias("check"), "subject", F.col("verdict").alias("label"), F.lit("warn").alias("severity"))
    return a.unionByName(b).unionByName(c)
