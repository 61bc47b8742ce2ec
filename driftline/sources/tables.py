"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``, opened by Spark's own reader so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
