"""Readers of tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A Parquet table of a directory; time stamps without a zone are taken as UTC."""
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    return df.withColumns({c: df[c].cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})
