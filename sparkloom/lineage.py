"""Where the lineage of iterative jobs is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder of spark.checkpoint.dir; only a session without that setting (a test on one machine) gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()
