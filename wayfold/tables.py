"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset and all runs on this machine, as in tests, a folder of our own, which goes at the end."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("executors of a cluster share no temporary folder: set spark.checkpoint.dir")
        path = getattr(context, "_wayfold_dir", None)
        if path is None:
            folder = tempfile.mkdtemp(prefix="wayfold-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            path = context._wayfold_dir = "file://" + folder
    return path.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: it cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/wayfold/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """``df``, never broadcast by a join: a file of repeated values is small, and its rows may still be more than a driver holds."""
    return df.hint("merge")
