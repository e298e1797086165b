"""Cutting the lineage of iterative plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or, in local mode only, one below the warehouse."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if spark.sparkContext.master.startswith("local"):
        return f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    raise ValueError("on a cluster, spark.checkpoint.dir must name a shared folder")


def checkpointed(df: DataFrame) -> DataFrame:
    """A checkpoint in ``checkpoint_folder``."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()
