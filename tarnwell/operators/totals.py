"""Sums per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals_by(df: DataFrame, key: str, **measures: Column) -> DataFrame:
    """Sum each measure per ``key`` under the measure's name."""
    return df.groupBy(key).agg(*(F.sum(m).alias(name) for name, m in measures.items()))
