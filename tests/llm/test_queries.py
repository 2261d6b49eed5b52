"""The registered queries over whole test tables, and against SQL where there is some."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from tarnwell.llm import queries as llm_queries

SF = Path("/root/testdata/sf0.001")


def duckdb_rows(sf_dir: Path, sql: str):
    con = duckdb.connect()
    for file in sorted(sf_dir.glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    result = con.execute(sql)
    columns = [name for name, *_ in result.description]
    return columns, result.fetchall()


@pytest.mark.parametrize("name", sorted(llm_queries.ORACLES))
def test_query_equals_duckdb(spark, name):
    columns, expected = duckdb_rows(SF, oracle_sql()[name])
    actual = queries()[name](spark, str(SF))
    assert actual.columns == columns
    assert sorted(map(tuple, actual.collect())) == sorted(expected)


def test_all_operators_and_the_pipeline_are_registered():
    assert {f"op{n}_" for n in range(1, 14)} <= {n[: n.index("_") + 1] for n in queries() if n.startswith("op")}
    assert "pipeline" in queries()


@pytest.mark.parametrize(
    "name", [n for n in sorted(llm_queries.QUERIES) if n not in ("op4_decontamination", "op5_voronoi_topk", "op9_packing")]
)
def test_one_row_for_each_document(spark, name):
    ids = queries()[name](spark, str(SF)).select("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
    assert ids.exceptAll(docs).isEmpty() and docs.exceptAll(ids).isEmpty()


# Pipeline ------------------------------------------------------------------------------


def test_stages_keep_columns_and_their_decisions_take_effect(spark):
    from test_model_and_join_operators import brute_links, brute_overlaps

    from tarnwell.llm.secret_scan import blanked

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "jaccard_join", "decontamination", "secret_scan", "packing"]
    odd = spark.createDataFrame(
        [(10_000, None, "en", "s", 0), (10_001, "12 34", "en", "s", 5), (10_002, "", None, "s", 0)], docs.schema
    )
    kept = stages["language_id"](spark, docs.union(odd), str(SF))
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect())

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    first = stages["jaccard_join"](spark, docs, str(SF))
    assert first.schema == docs.schema
    expected = sorted(d for d, n, c, _ in brute_links(rows, 80, 5) if n == 0 or d == c)
    assert sorted(r.doc_id for r in first.collect()) == expected
    assert len(expected) < len(rows)

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = stages["decontamination"](spark, docs, str(SF))
    assert clean.schema == docs.schema
    hit = {d for d, _ in brute_overlaps(rows, items[:6])}
    left = {r.doc_id for r in clean.collect()}
    assert not hit & left

    blank = stages["secret_scan"](spark, docs, str(SF))
    assert blank.schema == docs.schema
    assert {r.doc_id: (r.text, r.n_chars) for r in blank.collect()} == {
        d: (blanked(t), len(blanked(t))) for d, t in rows
    }


def test_the_run_is_the_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, str(SF)), "step")
    run = corpus_pipeline.run(spark, str(SF))
    assert run.exceptAll(docs).isEmpty() and docs.exceptAll(run).isEmpty()
    assert run.agg(F.countDistinct("doc_id")).first()[0] > 0


def test_the_pipeline_on_no_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_without_the_package_the_other_queries_stay(tmp_path):
    import shutil
    import subprocess

    root = Path(corpus_pipeline.__file__).parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "tarnwell", tmp_path / "tarnwell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(*e.queries(), *e.oracle_sql())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": ""}, capture_output=True, text=True)
    assert done.stdout.split() == ["revenue_by_nation"] * 2, done.stderr
