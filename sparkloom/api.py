"""One call from a file or table to its findings, for users who want no plans of their own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import forecasting, gates, preflight, profile, structure
from sparkloom.sources import files


@dataclass
class Findings:
    """Rows of findings that can be asked by their columns."""

    df: DataFrame

    def where(self, **given) -> Findings:
        """Rows whose columns equal the values given, or are among them."""
        out = self.df
        for c, v in given.items():
            out = out.where(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
        return Findings(out)

    def by_check(self, part: str) -> Findings:
        return Findings(self.df.where(F.lower("check").contains(part.lower())))

    def count_by_severity(self) -> dict[str, int]:
        return {r["severity"]: r["n"] for r in self.df.groupBy("severity").agg(F.count("*").alias("n")).collect()}


@dataclass
class Analysis:
    """What one run found; every part is a DataFrame that is worked out when it is read."""

    profile: DataFrame
    roles: DataFrame
    contract: DataFrame
    findings: Findings
    steps: DataFrame
    results: dict[str, DataFrame]
    forecast: DataFrame | None


def run(spark: SparkSession, data: DataFrame | str, depth: str = "auto", horizon: int = 7) -> Analysis:
    """depth: auto (profile, checks, steps, forecast) or quick (profile and checks). A path is loaded by its format; a time, else the first number, orders the rows of checks."""
    df = files.load(spark, data).df if isinstance(data, str) else data
    df = df.toDF(*files.canonical_names(df.columns))
    times = [c for c, t in df.dtypes if t.startswith(("timestamp", "date"))]
    order = next(iter(times), None) or next((c for c, t in df.dtypes if t in ("bigint", "int", "double")), df.columns[0])
    roles = structure.roles(df, order)
    sampled = preflight.sampling(df.withColumn("subject", F.lit("table")), times[0], [times[0]], ["subject"]) if times else spark.createDataFrame([], "subject string, verdict string")
    told = preflight.findings(preflight.missingness(df, df.columns, [order], times[0] if times else None), preflight.type_violations(df, df.columns, order), sampled)
    steps, results, forecast = spark.createDataFrame([], "place int, step string, applied boolean, reason string"), {}, None
    if depth != "quick":
        steps, results = gates.gated(df), gates.run(df)
        best = structure.target_choice(df.select(*profile.numeric_columns(df))).first() if profile.numeric_columns(df) else None
        if times and best:
            days = structure.daily(df, times[0], [best["column"]]).withColumn("series", F.lit(best["column"]))
            forecast = forecasting.chosen(days, ["series"], ["day"], best["column"], horizon)
    return Analysis(profile.profile(df), roles, structure.contract(roles, df.count()), Findings(told), steps, results, forecast)
