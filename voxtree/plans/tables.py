"""The input tables of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``name`` of the parquet tables under ``path``."""
    return spark.read.parquet(f"{path.rstrip('/')}/{name}.parquet")
