"""What a table is: roles of its columns, targets, shape, time and constraints, from one profile of all rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators.estimates import quantiles

from .profile import NA_TOKENS, numeric_columns

#: Parts of names that tell what a column holds.
TIME_NAMES = "time|date|ts|dt"
ID_NAMES = "^id$|_id$|uuid|guid|(nbr|number)$"
MEASURES = "count|num|number|total|injur|fatal|killed|amount|value"
AVERAGES = "per_day|rate|rolling|avg|mean"
SUMMED = "count|total|sum|injur|killed|fatal|crash|collision"
ORIGIN, DESTINATION = "^(origin|source|src|from)", "^(dest|destination|target|tgt|to)(_|$|ination)"


def _filled(c: str) -> Column:
    """The column with tokens for missing values made null."""
    return F.when(~F.lower(F.trim(F.col(c).cast("string"))).isin(*NA_TOKENS), F.col(c))


def roles(df: DataFrame, order: str) -> DataFrame:
    """column, role and the figures it rests on: place by name, times and numbers by the share that reads so, ids by name or near uniqueness, the rest by length and distinct values."""
    numbers = set(numeric_columns(df))
    at = F.unix_seconds(F.col(order).cast("timestamp")) if dict(df.dtypes)[order].startswith(("timestamp", "date")) else F.col(order)
    rising = df.select(*[F.expr(f"try_cast(CAST(`{c}` AS STRING) AS DOUBLE)").alias(c) for c in df.columns], at.alias("_o"))
    part = F.expr("floor(_o / 100000)")
    steps = rising.withColumn("_p", part).select("_p", *[(F.col(c) >= F.lag(c).over(Window.partitionBy("_p").orderBy("_o"))).alias(c) for c in df.columns], *[F.col(c).alias(f"_{c}") for c in df.columns])
    ends = steps.groupBy("_p").agg(*[F.min(f"_{c}").alias(f"lo_{c}") for c in df.columns], *[F.max(f"_{c}").alias(f"hi_{c}") for c in df.columns], *[F.coalesce(F.bool_and(c), F.lit(True)).alias(c) for c in df.columns])
    over = ends.select(*[(F.col(c) & F.coalesce(F.col(f"lo_{c}") >= F.lag(f"hi_{c}").over(Window.orderBy("_p")), F.lit(True))).alias(c) for c in df.columns])
    monotonic = over.agg(*[F.coalesce(F.bool_and(c), F.lit(True)).alias(c) for c in df.columns]).first()
    parts = []
    for c in df.columns:
        x, text = _filled(c), F.col(c).cast("string")
        looks, timed = bool(re.search(TIME_NAMES, c.lower())), dict(df.dtypes)[c].startswith(("timestamp", "date"))
        time = F.lit(1.0) if timed else F.avg(F.coalesce(F.try_to_timestamp(text).isNotNull(), F.lit(False)).cast("int")) if looks and c not in numbers else F.lit(0.0)
        number = F.lit(1.0) if c in numbers else F.avg(F.expr(f"try_cast(CAST(`{c}` AS STRING) AS DOUBLE) IS NOT NULL").cast("int"))
        length = F.lit(0.0) if c in numbers else F.avg(F.length(text))
        parts.append(F.struct(F.lit(c).alias("column"), F.lit(c in numbers).alias("is_number"), F.count("*").alias("n"), F.count(x).alias("filled"), F.count_distinct(x).alias("n_distinct"), time.cast("double").alias("datetime_rate"), number.cast("double").alias("numeric_rate"), length.cast("double").alias("length"), F.lit(bool(monotonic[c])).alias("monotonic")))
    told = df.agg(F.array(*parts).alias("p")).select(F.inline("p"))
    told = told.withColumn("missing_rate", 1 - F.col("filled") / F.greatest("n", F.lit(1))).withColumn("unique_ratio", F.col("n_distinct") / F.greatest("n", F.lit(1)))
    name = F.lower("column")
    first = F.when(name.rlike("^lat$|latitude"), "geo_lat").when(name.rlike("^(lon|lng)$|longitude"), "geo_lon").when(F.col("datetime_rate") >= 0.8, "datetime").when(F.col("is_number") | (F.col("numeric_rate") >= 0.9), "numeric")
    told = told.withColumn("_r", first)
    like_id = name.rlike(ID_NAMES) | (F.col("unique_ratio") > 0.98)
    role = (
        F.when((F.coalesce("_r", F.lit("")) != "datetime") & like_id, "id_like")
        .when(F.col("_r").isNotNull(), F.col("_r"))
        .when((F.col("n_distinct") <= 200) & (F.col("unique_ratio") < 0.2), "categorical")
        .when((F.col("length") >= 40) & (F.col("unique_ratio") > 0.5), "free_text")
        .otherwise("categorical")
    )
    return told.withColumn("role", role).drop("_r")


def targets(profiled: DataFrame, limit: int = 15) -> DataFrame:
    """Numeric columns by how good a target they make: filled, neither constant nor unique, named like a measure."""
    name = F.lower("column")
    score = 0.5 * (1 - F.col("missing_rate")) + F.greatest(F.lit(0.0), 0.5 - F.abs(F.col("unique_ratio") - 0.2)) + F.when(name.rlike(MEASURES), 0.5).otherwise(0.0) + F.when(name.rlike(AVERAGES), 0.2).otherwise(0.0)
    return profiled.where("role = 'numeric'").withColumn("score", score).orderBy(F.desc("score"), "column").limit(limit)


def contract(profiled: DataFrame, rows: int) -> DataFrame:
    """One row: counts, time and place, whether the table is fit for a basic and a deep analysis, and its recommended views."""
    named = lambda r: F.min(F.when(F.col("role") == r, F.col("column")))
    c = profiled.agg(F.lit(rows).cast("long").alias("n_rows"), F.count("*").alias("n_columns"), F.count_if(F.col("role") == "numeric").alias("n_numeric"), named("datetime").alias("time_column"), named("geo_lat").alias("_lat"), named("geo_lon").alias("_lon"), named("categorical").alias("_group"))
    geo, time, number = F.col("_lat").isNotNull() & F.col("_lon").isNotNull(), F.col("time_column").isNotNull(), F.col("n_numeric") > 0
    views = F.concat_ws(",", F.lit("raw_table"), F.when(number, "numeric_matrix"), F.when(time, "time_series_counts"), F.when(time & number, "time_series_numeric_sums"), F.when(geo, "geo_view"), F.when(time & F.col("_group").isNotNull(), "grouped_time_series_topk"))
    return c.select("n_rows", "n_columns", "n_numeric", "time_column", geo.alias("has_geo"), ((F.col("n_rows") >= 5) & (F.col("n_columns") >= 2)).alias("eligible_basic"), ((F.col("n_rows") >= 20) & number).alias("eligible_deep"), views.alias("views"))


def grouped_top(df: DataFrame, at: str, group: str, k: int) -> DataFrame:
    """Counts by day of the k groups with most rows, ties to the smaller group."""
    top = df.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(k).select(group)
    return df.join(F.broadcast(top), group, "left_semi").groupBy(F.date_format(at, "yyyy-MM-dd").alias("day"), group).agg(F.count("*").alias("n"))


def shape(df: DataFrame, small: int = 200_000, wide: int = 5000) -> DataFrame:
    """shape (small, very_wide, tall_sparse, network, panel, time_series or wide), time_column and panel_column of a table."""
    numbers = numeric_columns(df)
    parts = [F.struct(F.lit(c).alias("c"), F.count(c).alias("filled"), F.approx_count_distinct(c).alias("distinct")) for c in df.columns]
    n, found = df.agg(F.count("*"), F.array(*parts)).first()
    distinct, filled = {r["c"]: r["distinct"] for r in found}, {r["c"]: r["filled"] for r in found}
    times = [c for c, t in df.dtypes if t.startswith(("timestamp", "date"))] or [c for c in df.columns if re.search("timestamp|datetime|(^|_)date$", c.lower())]
    ids = [c for c in df.columns if re.search("(^|_)(id|station|user|entity|site|device|patient)(_|$)", c.lower()) and 3 <= distinct[c] < 0.5 * n]
    ends = [next((c for c in df.columns if re.search(p, c.lower())), None) for p in (ORIGIN, DESTINATION)]
    linked = all(ends) and max(distinct[c] for c in ends) <= 5 * max(1, min(distinct[c] for c in ends))
    holes = 1 - sum(filled.values()) / max(1, n * len(df.columns))
    kinds = (("small", n < small), ("very_wide", len(df.columns) >= wide), ("tall_sparse", holes >= 0.6), ("network", linked), ("panel", bool(ids and times)), ("time_series", bool(times) and len(numbers) >= 0.5 * (len(df.columns) - 1)), ("wide", True))
    row = (next(k for k, holds in kinds if holds), times[0] if times else None, ids[0] if ids else None)
    return df.sparkSession.createDataFrame([row], "shape string, time_column string, panel_column string")


def by_variance(df: DataFrame, most: int, always: list[str]) -> DataFrame:
    """column and place of `most` columns: those always kept, then by deviation times completeness (numbers one and a half times), in the table's order."""
    numbers = [c for c in numeric_columns(df) if c not in always]
    n, *figures = df.agg(F.count("*"), *[F.struct(F.stddev_pop(c).alias("s"), F.count(c).alias("f")) for c in numbers]).first()
    weight = {c: (x["s"] or 0.0) * x["f"] / max(1, n) * 1.5 for c, x in zip(numbers, figures, strict=True)}
    best = sorted(numbers, key=lambda c: (-weight[c], df.columns.index(c)))[: max(0, most - len(always))]
    kept = [c for c in df.columns if c in best or c in always]
    return df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(kept, 1)], "column string, place int")


def constraints(df: DataFrame) -> DataFrame:
    """column, kind (percent, fraction or nonnegative), low and high of the columns whose names or values call for bounds."""
    numbers = numeric_columns(df)
    parts = [F.struct(F.lit(c).alias("column"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"), F.avg((F.col(c) < 0).cast("int")).alias("below")) for c in numbers]
    told = df.agg(F.array(*parts).alias("p")).select(F.inline("p"))
    name = F.lower("column")
    kind = (
        F.when(name.rlike("percent|pct|humidity") & (F.col("lo") >= 0) & (F.col("hi") <= 100), "percent")
        .when((F.col("lo") >= 0) & (F.col("hi") <= 1), "fraction")
        .when((F.col("below") <= 0.0) | (name.rlike("count|total|quantity|distance|age") & (F.col("below") < 0.01)), "nonnegative")
    )
    return told.withColumn("kind", kind).where("kind IS NOT NULL").select("column", "kind", F.lit(0.0).alias("low"), F.when(F.col("kind") == "percent", 100.0).when(F.col("kind") == "fraction", 1.0).alias("high"))


def daily(df: DataFrame, at: str, values: list[str]) -> DataFrame:
    """A row for each day from first to last, empty ones too: columns named like counts are summed (0 where empty), others averaged."""
    day = F.to_date(at)
    summed = [c for c in values if re.search(SUMMED, c.lower())]
    each = df.groupBy(day.alias("day")).agg(*[(F.sum(c) if c in summed else F.avg(c)).alias(c) for c in values], F.count("*").alias("event_count"))
    calendar = df.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("day"))
    return calendar.join(each, "day", "left").fillna(0, ["event_count", *summed])


def target_choice(df: DataFrame) -> DataFrame:
    """The numeric column that makes the best target: by name, then by the spread of its middle 80 % in deviations; quantiles by running counts, so no task holds a column's values. A column without spread has no score."""
    cols = numeric_columns(df)
    name = lambda c: sum(2.0 for t in ("count", "total", "sum", "amount", "value", "rate", "injur", "killed", "fatal", "crash", "collision") if t in c) - 6.0 * bool(re.search(ID_NAMES + "|key$", c)) - 10.0 * bool(re.search("latitude|longitude|^lat$|^lon$", c))
    spread = df.agg(*[F.stddev_pop(c).alias(f"_{i}") for i, c in enumerate(cols)]).first() if cols else []
    scores = []
    for c, sd in zip(cols, spread, strict=True):
        low, high = quantiles(df.select(c), c, [0.1, 0.9]) if sd else (None, None)
        scores.append((c, float(name(c.lower()) + (high - low) / sd + 0.5) if sd else None))
    return df.sparkSession.createDataFrame(scores, "column string, score double").orderBy(F.desc("score"), "column").limit(1)


def canonical_time(df: DataFrame, stamp: str, order: str) -> DataFrame:
    """n, n_bad (times that don't read), cadence (median step in seconds) and monotonic (whether rows already were in order)."""
    t = df.select(F.try_to_timestamp(F.col(stamp)).alias("t"), F.col(order).alias("o"))
    cut = t.withColumn("p", F.to_date("t"))
    by_time, by_order = Window.partitionBy("p").orderBy("t", "o"), Window.partitionBy(F.floor(F.col("o") / 100_000)).orderBy("o")
    gaps = cut.where("t IS NOT NULL").withColumn("g", F.unix_seconds("t") - F.unix_seconds(F.lag("t").over(by_time)))
    edges = cut.where("t IS NOT NULL").groupBy("p").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    between = edges.select((F.unix_seconds("a") - F.unix_seconds(F.lag("b").over(Window.orderBy("p")))).alias("g"))
    cadence = gaps.select("g").unionByName(between).where("g IS NOT NULL").agg(F.median("g").alias("cadence"))
    steps = t.withColumn("ok", F.col("t") >= F.lag("t").over(by_order)).withColumn("p", F.floor(F.col("o") / 100_000))
    blocks = steps.groupBy("p").agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"), F.min("t").alias("a"), F.max("t").alias("b"))
    order_ok = blocks.select((F.col("ok") & F.coalesce(F.col("a") >= F.lag("b").over(Window.orderBy("p")), F.lit(True))).alias("ok")).agg(F.bool_and("ok").alias("monotonic"))
    return t.agg(F.count("*").alias("n"), F.count_if(F.col("t").isNull()).alias("n_bad")).join(cadence).join(order_ok)


def sanitized(df: DataFrame, ids: list[str]) -> DataFrame:
    """Numbers with infinities made null, without id columns."""
    double = {c for c, t in df.dtypes if t in ("double", "float")}
    finite = lambda c: F.when(F.abs(c) < float("inf"), F.col(c))
    return df.select(*[finite(c).alias(c) if c in double else F.col(c) for c in df.columns if c not in ids])


def clr(columns: list[str], floor: float = 1e-12) -> list[Column]:
    """Centred log ratios of parts; zeros are lifted to `floor`."""
    logs = [F.log(F.greatest(F.col(c), F.lit(floor))) for c in columns]
    mean = sum(logs[1:], logs[0]) / len(logs)
    return [x - mean for x in logs]


def ilr(columns: list[str], floor: float = 1e-12) -> list[Column]:
    """Isometric log ratios in the Helmert basis: part k + 1 against the mean of the parts before it."""
    logs = [F.log(F.greatest(F.col(c), F.lit(floor))) for c in columns]
    return [(sum(logs[1:k], logs[0]) - k * logs[k]) / (k * (k + 1)) ** 0.5 for k in range(1, len(logs))]


def compositional(df: DataFrame, columns: list[str], tolerance: float = 0.05, near: float = 0.1) -> DataFrame:
    """n, is_compositional (no part negative, row sums steady and near 1 or 100) and the means of both log-ratio transforms."""
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    mean, sd = F.avg(total), F.stddev_pop(total)
    holds = (F.min(F.least(*columns)) >= 0) & (sd / mean < tolerance) & ((F.abs(mean - 1) <= near) | (F.abs(mean - 100) <= 100 * near))
    return df.agg(F.count("*").alias("n"), holds.alias("is_compositional"), *[F.avg(x).alias(f"clr_{c}") for c, x in zip(columns, clr(columns), strict=True)], *[F.avg(x).alias(f"ilr_{k}") for k, x in enumerate(ilr(columns), 1)])
