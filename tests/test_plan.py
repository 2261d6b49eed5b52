"""What the plan must keep to stay cheap on large tables."""

from __future__ import annotations

import re

import duckdb
import pytest

from __spark_entry__ import oracle_sql
from tarnwell.plans import revenue_by_nation

SF = "/root/testdata/sf0.01"


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture
def shuffled_plan(spark, settings) -> str:
    """The plan when no side is small enough to broadcast."""
    settings("spark.sql.autoBroadcastJoinThreshold", "-1")
    return plan_of(revenue_by_nation(spark, SF))


def test_scans_read_only_the_columns_used(shuffled_plan):
    schemas = set(re.findall(r"ReadSchema: (struct<.*>)", shuffled_plan))
    assert schemas == {
        "struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double>",
        "struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>",
        "struct<c_custkey:bigint,c_nationkey:int>",
        "struct<n_nationkey:int,n_name:string>",
    }


def test_date_range_reaches_the_orders_scan(shuffled_plan):
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01T00:00)" in shuffled_plan
    assert "LessThan(o_orderdate,1997-01-01T00:00)" in shuffled_plan


def test_no_cross_join_and_no_python(shuffled_plan):
    for operator in ("CartesianProduct", "NestedLoop", "Python", "Arrow", "Broadcast"):
        assert operator not in shuffled_plan


def test_only_the_last_sum_is_started_before_its_shuffle(shuffled_plan):
    assert re.findall(r"Keys \[1\]: \[(\w+)#\d+L?\]\nFunctions \[2\]: \[partial_sum", shuffled_plan) == [
        "n_name"
    ]


def test_small_sides_are_broadcast_and_lines_stay_in_place(spark):
    plan = plan_of(revenue_by_nation(spark, SF))
    assert plan.count("BroadcastHashJoin Inner") == 3
    assert re.findall(r"hashpartitioning\((\w+)#", plan) == ["n_name"]


HOT = {
    "a hot order": ("l_orderkey", "IF(i % 3 = 0, 0, i % 50000)", "i", "i % 1000"),
    "a hot customer": ("o_custkey", "i % 50000", "i", "IF(i % 3 = 0, 0, i % 1000)"),
    "a repeated order": ("o_orderkey", "i % 50000", "IF(i % 3 = 0, 7, i)", "i % 1000"),
}


@pytest.mark.parametrize("case", sorted(HOT))
def test_joins_split_hot_keys(spark, settings, tmp_path, case):
    """Plain joins leave AQE free to split a partition that one key fills."""
    _, line_order, order_key, order_customer = HOT[case]
    lines = 200_000 if case != "a repeated order" else 60_000
    spark.range(lines, numPartitions=8).withColumnRenamed("id", "i").selectExpr(
        f"CAST({line_order} AS bigint) AS l_orderkey",
        "CAST(1 + i % 7 AS double) AS l_extendedprice",
        "0.05D AS l_discount",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(50_000, numPartitions=4).withColumnRenamed("id", "i").selectExpr(
        f"CAST({order_key} AS bigint) AS o_orderkey",
        f"CAST({order_customer} AS bigint) AS o_custkey",
        "timestamp_ntz'1996-05-05' AS o_orderdate",
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1000).selectExpr("id AS c_custkey", "CAST(id % 3 AS int) AS c_nationkey").write.parquet(
        f"{tmp_path}/customer.parquet"
    )
    spark.range(3).selectExpr("CAST(id AS int) AS n_nationkey", "CONCAT('N', id) AS n_name").write.parquet(
        f"{tmp_path}/nation.parquet"
    )
    settings("spark.sql.autoBroadcastJoinThreshold", "-1")
    settings("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    settings("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16KB")
    settings("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1KB")
    settings("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "16KB")
    settings("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.5")
    settings("spark.sql.shuffle.partitions", "32")
    result = revenue_by_nation(spark, str(tmp_path))
    rows = [tuple(row) for row in result.collect()]
    executed = result._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in executed

    con = duckdb.connect()
    for table in ("lineitem", "orders", "customer", "nation"):
        con.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')"
        )
    assert rows == con.execute(oracle_sql()["revenue_by_nation"]).fetchall()
