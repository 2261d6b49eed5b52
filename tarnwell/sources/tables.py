"""Tables kept as ``<directory>/<name>.parquet``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Read one table lazily; ``directory`` may be a local path or any URI Spark knows."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
