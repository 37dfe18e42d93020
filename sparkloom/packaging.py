"""Sending this package to the executors, so that tasks can import it wherever the driver runs."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: dict[str, str] = {}


def shipped(spark: SparkSession) -> SparkSession:
    """The session, after its application has been given this package as a zip; once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        top = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "sparkloom.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        context.addPyFile(path)
        _sent[context.applicationId] = path
    return spark
