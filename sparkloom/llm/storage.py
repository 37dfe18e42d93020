"""Where the lineage of long jobs is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    """The shared folder of spark.checkpoint.dir. Only a session without that setting (a test on one machine) gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, so that lost executors cost no earlier work."""
    _folder(df)
    return df.checkpoint()


def reread(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again."""
    path = f"{_folder(df)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
