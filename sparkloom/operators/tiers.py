"""Samples in tiers: a larger one contains the smaller, whatever the shape of the table.

Every row has a priority, a hash of its content and of a seed that the table's content gives;
a sample takes the rows of least priority of each stratum. Strata don't depend on the tier, so
the rows that a tier takes of a stratum begin with those of the tier before. A stratum that
holds most rows is first cut down within parts by hash, then over the parts.

Methods by shape: `stratified_temporal` (strata of equal numbers by time), `stratified_panel`
(entities by equal spans of time), `completeness_biased` (rows with most values first),
`random` (strata by a hash, which keep the sample's size exact). Rows without a time are left
out of the first two, as are those without an entity; rows that are equal to the last column
share a priority and come in no order that matters.
"""

from __future__ import annotations

import hashlib

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import structure

#: Rows and columns of the tiers; the last one has all.
BUDGETS = {1: (100_000, 200), 2: (1_000_000, 1000), 3: (None, None)}
METHODS = {"time_series": "stratified_temporal", "panel": "stratified_panel", "tall_sparse": "completeness_biased"}
PARTS = 32


def content_seed(df: DataFrame) -> str:
    """Eight hex digits that depend on the rows alone, in whatever order or number of files they come."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns) if not df.schema[c].dataType.simpleString().startswith("map")])
    n, total, mixed = df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return hashlib.sha256(f"{sorted(df.dtypes)}:{n}:{total}:{mixed}".encode()).hexdigest()[:8]


def _priority(df: DataFrame, seed: str) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in sorted(df.columns) if not df.schema[c].dataType.simpleString().startswith("map")])


def least(df: DataFrame, strata: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each stratum; of each stratum's parts first, so that none has to be sorted whole."""
    part = F.pmod(F.xxhash64(*order, F.lit(7)), F.lit(PARTS)).cast("int")
    rank = lambda *by: F.row_number().over(Window.partitionBy(*strata, *by).orderBy(*order))
    cut = df.withColumn("_part", part).withColumn("_n", rank("_part")).where(F.col("_n") <= most)
    return cut.withColumn("_n", rank()).where(F.col("_n") <= most).drop("_part", "_n")


def _strata(df: DataFrame, method: str, time: str | None, entity: str | None, target: int) -> tuple[DataFrame, int]:
    """The rows with `_s` columns of their stratum, and how many strata there are."""
    if method == "random":
        return df.withColumn("_s1", F.pmod(F.col("_p"), F.lit(PARTS)).cast("int")).withColumn("_s2", F.lit(0)), PARTS
    if method == "completeness_biased":
        return df.withColumns({"_s1": F.lit(0), "_s2": F.lit(0)}), 1
    at = F.unix_micros(F.try_to_timestamp(F.col(time).cast("string")))
    df = df.withColumn("_t", at).where("_t IS NOT NULL")
    if method == "stratified_temporal":
        bins = max(50, min(500, target // 200))
        cuts = sorted(set(df.agg(F.percentile_approx("_t", F.lit([i / bins for i in range(1, bins)]), F.lit(20_000))).first()[0] or []))
        if not cuts:
            return df.withColumns({"_s1": F.lit(0), "_s2": F.lit(0)}), 1
        splits = [float("-inf"), *map(float, cuts), float("inf")]
        placed = Bucketizer(splits=splits, inputCol="_d", outputCol="_s1").transform(df.withColumn("_d", F.col("_t").cast("double")))
        return placed.withColumn("_s2", F.lit(0)), len(cuts) + 1
    df = df.where(F.col(entity).isNotNull())
    lo, hi, n = df.agg(F.min("_t"), F.max("_t"), F.count_distinct(entity)).first()
    bins = max(1, min(20, target // max(1, n or 1)))
    width = max(1, ((hi or 0) - (lo or 0)) / bins)
    return df.withColumns({"_s1": F.col(entity), "_s2": F.least(F.lit(bins - 1), F.floor((F.col("_t") - (lo or 0)) / width)).cast("int")}), max(1, (n or 0) * bins)


def sample(df: DataFrame, method: str, rows: int, time: str | None = None, entity: str | None = None, seed: str | None = None, strata_for: int | None = None) -> DataFrame:
    """About `rows` rows by a method: the same number of each stratum. `strata_for`: the number of rows that strata are cut for, the same in all tiers."""
    seed = content_seed(df) if seed is None else seed
    placed, strata = _strata(df.withColumn("_p", _priority(df, seed)), method, time, entity, strata_for or rows)
    filled = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in df.columns), F.lit(0))
    order = [-filled, F.col("_p")] if method == "completeness_biased" else [F.col("_p")]
    return least(placed, ["_s1", "_s2"], order, max(1, rows // strata)).select(*[F.col(f"`{c}`") for c in df.columns])


def tiers(df: DataFrame, budgets: dict[int, tuple[int | None, int | None]] | None = None, always: list[str] | None = None, small: int = 200_000) -> tuple[dict[int, DataFrame], DataFrame]:
    """The sample of each tier, and a table of tier, shape, method, seed, rows_wanted, n_columns. Small tables are taken whole in the last tier alone. Columns beyond a tier's number go by variance, those in `always` and of time and entity stay."""
    budgets = BUDGETS if budgets is None else budgets
    found = structure.shape(df, small=small).first()
    method = METHODS.get(found["shape"], "random")
    seed = content_seed(df)
    smallest = min((r for r, _ in budgets.values() if r), default=1)
    out, told = {}, []
    for tier, (rows, columns) in sorted(budgets.items()):
        if found["shape"] == "small" and tier != max(budgets):
            continue
        part = df if rows is None or found["shape"] == "small" else sample(df, method, rows, found["time_column"], found["panel_column"], seed, smallest)
        names = df.columns
        if columns is not None and len(names) > columns:
            must = [c for c in dict.fromkeys([*(always or []), found["time_column"], found["panel_column"]]) if c]
            kept = {r["column"] for r in structure.by_variance(df, columns, must).collect()}
            names = [c for c in names if c in kept]
        out[tier] = part.select(*[F.col(f"`{c}`") for c in names])
        told.append((tier, found["shape"], "all" if rows is None or found["shape"] == "small" else method, seed, rows, len(names)))
    return out, df.sparkSession.createDataFrame(told, "tier int, shape string, method string, seed string, rows_wanted long, n_columns int")
