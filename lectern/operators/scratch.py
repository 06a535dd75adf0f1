"""The folder that all executors share, for lineage that is cut and tables that are read again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: what spark.checkpoint.dir names, or a folder of our own on a single machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lectern-"))
    return context.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()
