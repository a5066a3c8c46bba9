"""The shared folder, and cutting of lineage in it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _context_with_folder(spark: SparkSession):
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(found or f"file://{tempfile.mkdtemp(prefix='textquarry-')}")
    return context


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name within that of spark.checkpoint.dir. Where that is unset, in one of our own in local mode, else an error."""
    return f"{_context_with_folder(spark).getCheckpointDir().rstrip('/')}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir; see shared_folder()."""
    _context_with_folder(df.sparkSession)
    return df.checkpoint()
