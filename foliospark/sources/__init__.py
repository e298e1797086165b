"""Readers of the source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One source table, stored as Parquet below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
