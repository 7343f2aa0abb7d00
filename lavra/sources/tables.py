"""Parquet scans of the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table; column pruning and filters reach the Parquet reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
