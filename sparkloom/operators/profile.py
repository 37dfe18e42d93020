"""Column profiles, roles, missingness and value types, each in one pass over the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC)]


def profile(df: DataFrame) -> DataFrame:
    """A row for each column: n_total, n_missing, completeness, n_distinct, and mean, std (population), min and max of numbers.

    One aggregation computes all; the wide row is then turned into long form.
    Distinct values are counted approximately (HyperLogLog), so that wide tables
    need no shuffle of their values.
    """
    numbers = set(numeric_columns(df))
    parts: list[Column] = []
    for c in df.columns:
        x = F.col(f"`{c}`")
        value = F.nanvl(x.cast("double"), F.lit(None).cast("double")) if c in numbers else F.lit(None).cast("double")
        missing = F.count_if(x.isNull() | F.isnan(x.cast("double"))) if c in numbers else F.count_if(x.isNull())
        parts.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("n_total"), missing.alias("n_missing"), F.approx_count_distinct(x, 0.02).alias("n_distinct"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")))
    wide = df.agg(F.array(*parts).alias("p"))
    row = wide.select(F.inline("p"))
    return row.withColumn("completeness", 1 - F.col("n_missing") / F.greatest("n_total", F.lit(1)))


def value_type(text: Column) -> Column:
    """The type that one text value looks like: empty, boolean, integer, float, datetime or string."""
    t = F.trim(text)
    return (
        F.when(text.isNull() | (t == "") | F.lower(t).isin(*NA_TOKENS), F.lit("empty"))
        .when(F.lower(t).isin("true", "false", "yes", "no", "y", "n"), "boolean")
        .when(F.try_to_number(F.translate(t, "+-", ""), F.lit("999,999,999,999,999,999")).isNotNull() | t.rlike("^[+-]?[0-9]+$"), "integer")
        .when(t.cast("string").rlike("^[-+]?[0-9]*[.]?[0-9]+([eE][-+]?[0-9]+)?$"), "float")
        .when(F.try_to_timestamp(t).isNotNull(), "datetime")
        .otherwise("string")
    )


#: Texts that stand for a missing value.
NA_TOKENS = ("", "na", "n/a", "nan", "null", "none", "-", "--", "---", "?", "??", "missing")


def value_types(df: DataFrame, columns: list[str], dominance: float = 0.7) -> DataFrame:
    """column, dominant type (`mixed` below the share), its share of filled values and the number of other filled values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), value_type(F.col(c).cast("string")).alias("type")) for c in columns])).alias("x")).select("x.*")
    counts = long.groupBy("column", "type").agg(F.count("*").alias("n"))
    each = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("type") != "empty", F.col("n"))), F.lit(0)).alias("filled"),
        F.max(F.when(F.col("type") != "empty", F.struct("n", "type"))).alias("top"),
    )
    share = F.col("top.n") / F.col("filled")
    return each.select("column", F.when(F.col("filled") == 0, "empty").when(share >= dominance, F.col("top.type")).otherwise("mixed").alias("type"), F.coalesce(share, F.lit(0.0)).alias("share"), (F.col("filled") - F.coalesce("top.n", F.lit(0))).alias("n_other"))


def roles(profiled: DataFrame) -> DataFrame:
    """A role for each profiled column: id_like, datetime, numeric, categorical or free_text, by name and counts."""
    name = F.lower("column")
    ratio = F.col("n_distinct") / F.greatest(F.col("n_total") - F.col("n_missing"), F.lit(1))
    return profiled.withColumn(
        "role",
        F.when(name.rlike("(^|_)(lat|latitude)$"), "geo_lat")
        .when(name.rlike("(^|_)(lon|lng|longitude)$"), "geo_lon")
        .when(name.rlike("date|time|(^|_)ts$"), "datetime")
        .when(name.rlike("(^id$|_id$|key$|uuid|guid)"), "id_like")
        .when(F.col("mean").isNotNull(), "numeric")
        .when((F.col("n_distinct") <= 200) & (ratio < 0.2), "categorical")
        .otherwise("free_text"),
    )


def violations(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """column, n_violations, fraction, lowest, highest and severity (ok, warn under 1 %, fail) of each bounded column."""
    parts = []
    for c, (low, high) in bounds.items():
        x = F.col(c).cast("double")
        outside = reduce(lambda a, b: a | b, [t for t in ((x < low) if low is not None else None, (x > high) if high is not None else None) if t is not None])
        parts.append(F.struct(F.lit(c).alias("column"), F.count_if(outside).alias("n_violations"), (F.count_if(outside) / F.greatest(F.count(x), F.lit(1))).alias("fraction"), F.min(x).alias("lowest"), F.max(x).alias("highest")))
    long = df.agg(F.array(*parts).alias("p")).select(F.inline("p"))
    return long.withColumn("severity", F.when(F.col("n_violations") == 0, "ok").when(F.col("fraction") < 0.01, "warn").otherwise("fail"))


def clamped(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """The rows with each bounded column moved into its bounds; nulls stay."""
    new = {}
    for c, (low, high) in bounds.items():
        x = F.col(c)
        x = x if low is None else F.when(x < low, F.lit(low)).otherwise(x)
        new[c] = x if high is None else F.when(x > high, F.lit(high)).otherwise(x)
    return df.withColumns(new)
