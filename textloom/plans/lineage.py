"""Cutting lineage in a folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def use_shared_checkpoints(spark: SparkSession) -> None:
    """Take the folder of ``spark.checkpoint.dir``; a temporary one only where none is set and the session is local."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="textloom-checkpoints-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read again from reliable storage, so that lost executors cost nothing."""
    use_shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)
