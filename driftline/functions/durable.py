"""Lineage cuts that survive a lost executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; only where none is set (tests), make one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="driftline-checkpoint-")
        sc.setCheckpointDir(named)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which the driver and all executors can read."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder; later plans start there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
