"""revenue_by_nation on small tables, against a nested-loop count in plain Python."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal

import duckdb
import pytest
from pyspark.errors import ArithmeticException

from __spark_entry__ import oracle_sql
from tarnwell.plans import revenue_by_nation

SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_extendedprice double, l_discount double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_name string",
}
START, END = datetime(1996, 1, 1), datetime(1997, 1, 1)
INSIDE = datetime(1996, 6, 1)

both_ways = pytest.mark.parametrize(
    "threshold", ["10MB", "-1"], ids=["broadcast", "shuffled"]
)


def write(spark, path, **tables):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(tables.get(name, []), schema).write.parquet(
            f"{path}/{name}.parquet"
        )
    return str(path)


def rows_of(df):
    return [tuple(row) for row in df.collect()]


def cents(value: float) -> Decimal:
    return Decimal(repr(value)).quantize(Decimal("0.01"), ROUND_HALF_UP)


def brute_force(lineitem, orders, customer, nation):
    counts, sums = defaultdict(int), {}
    for l_order, price, discount in lineitem:
        for order, cust, date in orders:
            if l_order is None or order != l_order or date is None:
                continue
            if not START <= date < END:
                continue
            for customer_key, nation_key in customer:
                if cust is None or customer_key != cust:
                    continue
                for key, name in nation:
                    if nation_key is None or key != nation_key:
                        continue
                    counts[name] += 1
                    sums.setdefault(name, None)
                    if price is not None and discount is not None:
                        net = cents(price) * (1 - cents(discount))
                        sums[name] = (sums[name] or Decimal(0)) + net
    return [(name, counts[name], sums[name]) for name in sorted(counts)]


def random_tables(seed: int):
    """Small tables with repeated, missing and unmatched keys."""
    rng = random.Random(seed)
    dates = [datetime(1995, 12, 31), START, INSIDE, datetime(1996, 12, 31, 23), END, None]
    return {
        "nation": [(i, f"N{i % 4}") for i in range(6)] + [(1, "twice"), (None, "none")],
        "customer": [(rng.choice([i, i, None]), rng.choice([0, 1, 2, 5, 9, None])) for i in range(20)]
        + [(3, 1), (3, 2)],
        "orders": [
            (rng.choice([i, i, i, None]), rng.choice([*range(22), None]), rng.choice(dates))
            for i in range(60)
        ]
        + [(7, 3, INSIDE), (7, 3, INSIDE)],
        "lineitem": [
            (
                rng.choice([*range(62), None]),
                rng.choice([round(rng.uniform(1, 9e4), 2), None] + [12.5] * 3),
                rng.choice([0.0, 0.05, 0.1, 1.0, None]),
            )
            for _ in range(400)
        ],
    }


@both_ways
@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, settings, tmp_path, seed, threshold):
    settings("spark.sql.autoBroadcastJoinThreshold", threshold)
    tables = random_tables(seed)
    expected = brute_force(**tables)
    assert expected
    assert rows_of(revenue_by_nation(spark, write(spark, tmp_path, **tables))) == expected


@both_ways
def test_one_order_customer_and_nation_hold_most_rows(spark, settings, tmp_path, threshold):
    settings("spark.sql.autoBroadcastJoinThreshold", threshold)
    rng = random.Random(11)
    tables = {
        "nation": [(i, f"N{i}") for i in range(5)],
        "customer": [(i, 0 if i % 2 else i % 5) for i in range(40)],
        "orders": [(i, 1 if i % 2 else i % 40, INSIDE) for i in range(200)],
        "lineitem": [
            (1 if i % 2 else rng.randrange(200), round(rng.uniform(1, 9e4), 2), 0.07)
            for i in range(4000)
        ],
    }
    path = write(spark, tmp_path, **tables)
    assert rows_of(revenue_by_nation(spark, path)) == brute_force(**tables)


BAD = {"price": (2e10, 0.0), "discount": (1.0, 25.0)}


def with_bad_line(place: str, bad: tuple[float, float]) -> dict:
    """One good line of 10, and one whose measures don't fit their decimals."""
    orders = [(0, 0, INSIDE), (1, 0, START if place == "counted" else END), (2, 99, INSIDE)]
    order_of = {"outside the range": 1, "without an order": 50, "without a customer": 2, "counted": 1}
    return {
        "nation": [(0, "A")],
        "customer": [(0, 0)],
        "orders": orders,
        "lineitem": [(0, 10.0, 0.0), (order_of[place], *bad)],
    }


@both_ways
@pytest.mark.parametrize("kind", sorted(BAD))
@pytest.mark.parametrize("place", ["outside the range", "without an order", "without a customer"])
def test_lines_that_are_not_counted_cannot_fail(spark, settings, tmp_path, threshold, kind, place):
    settings("spark.sql.autoBroadcastJoinThreshold", threshold)
    path = write(spark, tmp_path, **with_bad_line(place, BAD[kind]))
    expected = [("A", 1, Decimal("10.0000"))]
    assert rows_of(revenue_by_nation(spark, path)) == expected
    con = duckdb.connect()
    for table in SCHEMAS:
        con.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/{table}.parquet/*.parquet')"
        )
    assert con.execute(oracle_sql()["revenue_by_nation"]).fetchall() == expected


@both_ways
@pytest.mark.parametrize("kind", sorted(BAD))
def test_a_counted_line_that_does_not_fit_fails(spark, settings, tmp_path, threshold, kind):
    settings("spark.sql.autoBroadcastJoinThreshold", threshold)
    path = write(spark, tmp_path, **with_bad_line("counted", BAD[kind]))
    with pytest.raises(ArithmeticException):
        rows_of(revenue_by_nation(spark, path))


def test_start_is_included_and_end_is_not(spark, tmp_path):
    dates = [START, datetime(1996, 12, 31, 23, 59, 59, 999999), END, datetime(1995, 12, 31, 23, 59, 59)]
    path = write(
        spark,
        tmp_path,
        nation=[(0, "A")],
        customer=[(0, 0)],
        orders=[(i, 0, date) for i, date in enumerate(dates)],
        lineitem=[(i, 10.0**i, 0.0) for i in range(4)],
    )
    assert rows_of(revenue_by_nation(spark, path)) == [("A", 2, Decimal("11.0000"))]
    later = revenue_by_nation(spark, path, "1997-01-01", "1998-01-01")
    assert rows_of(later) == [("A", 1, Decimal("100.0000"))]


def test_no_matching_rows_gives_an_empty_result(spark, tmp_path):
    result = revenue_by_nation(spark, write(spark, tmp_path, nation=[(0, "A")]))
    assert result.schema.simpleString() == (
        "struct<nation_name:string,line_count:bigint,revenue:decimal(27,4)>"
    )
    assert rows_of(result) == []


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_session_time_zone_changes_nothing(spark, settings, zone):
    settings("spark.sql.session.timeZone", zone)
    rows = rows_of(revenue_by_nation(spark, "/root/testdata/sf0.001"))
    assert sum(count for _, count, _ in rows) == 920


def test_trailing_slash_in_the_directory(spark):
    plain = rows_of(revenue_by_nation(spark, "/root/testdata/sf0.001"))
    assert rows_of(revenue_by_nation(spark, "/root/testdata/sf0.001/")) == plain
