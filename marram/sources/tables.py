"""Table access: one place that knows where a named table lives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``root``; column pruning is left to the plan."""
    return spark.read.parquet(f"{root}/{name}.parquet")
