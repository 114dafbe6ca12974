"""Readers of the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of Parquet files or directories."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
