"""Readers of the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table of that name in a project folder (a file or a directory of parts)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
