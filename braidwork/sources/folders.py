"""The folder for what a query writes for others to read."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """From spark.checkpoint.dir, which all executors share. Where that is unset: a temporary one if Spark is this one process, else one in the warehouse."""
    context = spark.sparkContext
    kept = context.getCheckpointDir()
    if kept:
        return kept
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return context.getCheckpointDir()
