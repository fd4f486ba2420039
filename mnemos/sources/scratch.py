"""Results of steps that later steps read again: written to the checkpoint folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local master may leave it unset (a temporary folder is then set)."""
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="mnemos-checkpoints-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and read from the checkpoint folder from then on."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()
