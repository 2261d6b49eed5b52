"""Revenue reports over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions import discounted_price
from tarnwell.operators import totals_by
from tarnwell.sources import read_table


def revenue_by_nation(
    spark: SparkSession,
    directory: str,
    start: str = "1996-01-01",
    end: str = "1997-01-01",
) -> DataFrame:
    """Line count and discounted revenue per customer nation.

    Counts the lines of orders dated from ``start`` up to, not including, ``end``.
    Measures are worked out after the joins, so lines that are not counted can't fail.
    """
    lines = read_table(spark, directory, "lineitem")
    orders = (
        read_table(spark, directory, "orders")
        .filter(
            (F.col("o_orderdate") >= F.lit(start).cast("timestamp_ntz"))
            & (F.col("o_orderdate") < F.lit(end).cast("timestamp_ntz"))
        )
        .select("o_orderkey", "o_custkey")
    )
    customers = read_table(spark, directory, "customer").select("c_custkey", "c_nationkey")
    nations = read_table(spark, directory, "nation").select("n_nationkey", "n_name")

    counted = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return (
        totals_by(
            counted,
            "n_name",
            line_count=F.lit(1).cast("bigint"),
            revenue=discounted_price(F.col("l_extendedprice"), F.col("l_discount")),
        )
        .select(
            F.col("n_name").alias("nation_name"),
            "line_count",
            F.col("revenue").cast("decimal(27,4)").alias("revenue"),
        )
        .orderBy("nation_name")
    )
