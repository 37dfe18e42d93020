"""Structured Streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, at: str, width: str, lateness: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums by window and keys; rows later than the watermark are dropped. Works on streams and tables."""
    return events.withWatermark(at, lateness).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("starts"), *keys, "n", "total")


def deduplicated(findings: DataFrame, at: str, keys: list[str], lateness: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return findings.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def contracts(events: DataFrame, rules: dict[str, str]) -> DataFrame:
    """The rows with the names of the rules (SQL predicates) that they satisfy; rows that satisfy none are left out."""
    names = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in rules.items()]))
    return events.withColumn("contracts", names).where(F.size("contracts") > 0)


def sessions(events: DataFrame, at: str, gap: str, lateness: str, keys: list[str]) -> DataFrame:
    """Counts by session: a session ends when a key is silent for `gap`."""
    w = F.session_window(at, gap)
    return events.withWatermark(at, lateness).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("starts"), F.col("session_window.end").alias("ends"), *keys, "n")


def incremental(stream: DataFrame, analyse, folder: str, key: str) -> None:
    """Runs analyse(batch) on each micro-batch and writes what its findings are against those so far: new_finding, repeated, and a window_advanced row for the batch."""
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        found = analyse(batch).withColumn("batch", F.lit(number).cast("long"))
        before = spark.read.schema(found.schema).parquet(f"{folder}/findings").where(F.col("batch") < number).select(key).distinct() if number else found.select(key).limit(0)
        known = before.withColumn("_k", F.lit(True))
        told = found.join(known, key, "left").select(key, F.when(F.col("_k"), "repeated").otherwise("new_finding").alias("event"))
        advanced = batch.agg(F.count("*").cast("string").alias(key)).withColumn("event", F.lit("window_advanced"))
        told.select(F.col(key).cast("string"), "event").unionByName(advanced).write.mode("overwrite").parquet(f"{folder}/events/batch={number}")
        found.drop("batch").write.mode("overwrite").parquet(f"{folder}/findings/batch={number}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
