"""Tables that are kept by their changes: pinned runs, and vectors with added and removed parts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators.nearest import nearest


def newest(runs: DataFrame, finished: str, at: str, key: str, most: int = 50) -> DataFrame:
    """The newest complete runs (`finished` true); ties of time to the greater key. A null time comes last."""
    return runs.where(F.col(finished)).orderBy(F.desc_nulls_last(at), F.desc(key)).limit(most)


def pins(log: DataFrame, workspace: str, run: str, at: str, note: str, most: int = 100) -> DataFrame:
    """workspace, run, at, note and place of what is pinned: pinning again moves a run up and keeps its note unless a new one is given; the newest `most` of each workspace stay.

    Rows without a run are left out; ties of time go to the smaller run.
    """
    told = log.where(F.col(run).isNotNull() & (F.col(run).cast("string") != "")).groupBy(workspace, run).agg(F.max(at).alias("at"), F.max_by(note, F.when(F.col(note).isNotNull(), F.struct(at, note))).alias("note"))
    place = F.row_number().over(Window.partitionBy(workspace).orderBy(F.desc("at"), run))
    return told.withColumn("place", place).where(F.col("place") <= most)


def live(changes: DataFrame, key: str, at: str, vector: str) -> DataFrame:
    """key and vector of what the latest change of each key left: a null vector takes it away. Of equal times a vector goes before a removal, then the greater one wins."""
    last = F.max(F.struct(at, F.col(vector).isNotNull().alias("there"), F.col(vector).alias("v"))).alias("c")
    return changes.groupBy(key).agg(last).where("c.there").select(key, F.col("c.v").alias(vector))


class VectorTable:
    """Vectors in a shared folder as Parquet parts by version: adding and removing write a part, nothing is rewritten before `compact`.

    One writer at a time; a part that is written again after a lost executor is the same part.
    """

    SCHEMA = "id long, v array<double>, removed boolean, version long"

    def __init__(self, spark: SparkSession, folder: str, dims: int):
        self.spark, self.folder, self.dims = spark, folder, dims

    def _parts(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.folder)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def _write(self, rows: DataFrame, version: int | None = None) -> int:
        if version is None:
            version = (self._parts().agg(F.max("version")).first()[0] or 0) + 1
        rows.write.mode("overwrite").parquet(f"{self.folder.rstrip('/')}/version={version}")
        return version

    def add(self, rows: DataFrame) -> int:
        """Adds or replaces (id, v); vectors are scaled to length 1. Refuses vectors of other dimensions; of rows of one id the greatest vector stays."""
        v = F.transform("v", lambda x: x.cast("double"))
        bad = rows.where(F.col("v").isNull() | (F.size("v") != self.dims)).limit(1).count()
        if bad:
            raise ValueError(f"vectors must have {self.dims} dimensions")
        size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        one = rows.select(F.col("id").cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.max("v").alias("v"))
        return self._write(one.select("id", F.when(size > 0, F.transform("v", lambda x: x / size)).otherwise(F.col("v")).alias("v"), F.lit(False).alias("removed")))

    def remove(self, ids: DataFrame) -> int:
        """Takes rows of `id` away; ids that are not there change nothing."""
        return self._write(ids.select(F.col("id").cast("long").alias("id"), F.lit(None).cast("array<double>").alias("v"), F.lit(True).alias("removed")).distinct())

    def rows(self) -> DataFrame:
        """id and v as they are now."""
        return live(self._parts(), "id", "version", "v")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, id and score (cosine) of the k nearest rows of each query (id, v), its own id among them."""
        return nearest(queries, self.rows(), "id", "v", k, itself=True)

    def compact(self, folder: str) -> VectorTable:
        """The rows as they are now in one version of another folder; the old one stays until its readers are done."""
        other = VectorTable(self.spark, folder, self.dims)
        other._write(self.rows().withColumn("removed", F.lit(False)), 1)
        return other
