"""The driver's contract: every query against its SQL twin in DuckDB."""

from __future__ import annotations

import re
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

DATA = Path("/root/testdata")
SCALES = ["sf0.001", "sf0.01", "sf0.1"]


def duckdb_rows(sf_dir: Path, sql: str):
    con = duckdb.connect()
    for file in sorted(sf_dir.glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    result = con.execute(sql)
    columns = [(name, str(kind)) for name, kind, *_ in result.description]
    return columns, result.fetchall()


#: Queries for training data have tests of their own, beside brute force where SQL can't express them.
OWN = [name for name in queries() if not re.match(r"op\d+_|pipeline$", name)]
SPARK_TYPES = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double"}


def test_every_query_has_an_oracle_and_every_oracle_a_query():
    assert OWN
    assert set(OWN) == set(oracle_sql()) & set(OWN)
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows_and_a_stable_schema(spark):
    first, second = entry(spark), entry(spark)
    assert first.schema == second.schema
    assert first.schema.simpleString() == (
        "struct<nation_name:string,line_count:bigint,revenue:decimal(27,4)>"
    )
    assert first.count() == 25


@pytest.mark.parametrize("scale", SCALES)
@pytest.mark.parametrize("name", OWN)
def test_query_equals_duckdb(spark, name, scale):
    columns, expected = duckdb_rows(DATA / scale, oracle_sql()[name])
    actual = queries()[name](spark, str(DATA / scale))
    assert actual.columns == [column for column, _ in columns]
    assert [kind for _, kind in actual.dtypes] == [
        SPARK_TYPES.get(kind, kind.lower()) for _, kind in columns
    ]
    assert [tuple(row) for row in actual.collect()] == expected


@pytest.mark.parametrize(
    ("scale", "lines", "nation_0"),
    [
        ("sf0.001", 920, (29, Decimal("1517405.7430"))),
        ("sf0.01", 9015, (322, Decimal("16783820.5234"))),
        ("sf0.1", 91392, (3344, Decimal("173120255.6366"))),
    ],
)
def test_totals_recorded_in_the_survey(spark, scale, lines, nation_0):
    rows = queries()["revenue_by_nation"](spark, str(DATA / scale)).collect()
    assert len(rows) == 25
    assert sum(row.line_count for row in rows) == lines
    found = {row.nation_name: (row.line_count, row.revenue) for row in rows}
    assert found["NATION_0"] == nation_0


def test_a_missing_library_leaves_the_other_queries():
    root = Path(__file__).resolve().parent.parent
    code = (
        "import sys; sys.modules['xxhash'] = None; sys.path.insert(0, sys.argv[1])\n"
        "import __spark_entry__ as e; print(*e.queries(), *e.oracle_sql())"
    )
    done = subprocess.run([sys.executable, "-c", code, str(root)], capture_output=True, text=True)
    assert done.stdout.split() == ["revenue_by_nation"] * 2, done.stderr
