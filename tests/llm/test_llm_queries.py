"""The queries that have SQL, against DuckDB, and what is in the operators' plans."""

import os

import duckdb
import pytest

from tollbridge.llm.queries import ORACLES, QUERIES

SMALL_DIR = "/root/testdata/sf0.001"
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    df = QUERIES[name](spark, SF_DIR)
    columns = ", ".join(sorted(df.columns))
    wanted = con.sql(f"SELECT {columns} FROM ({ORACLES[name]}) ORDER BY ALL").fetchall()
    got = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    assert wanted and sorted(got, key=str) == sorted(wanted, key=str)


@pytest.mark.parametrize("name", ["op6_license_scan", "op8_line_dedup", "op9_quality_rules"])
def test_native_operators_run_no_python(spark, name):
    text = QUERIES[name](spark, SMALL_DIR)._jdf.queryExecution().executedPlan().toString()
    for bad in ("Python", "Arrow", "Pandas", "NestedLoop", "CartesianProduct"):
        assert bad not in text


@pytest.mark.parametrize("name", ["op1_secret_scan", "op4_language", "op5_html_text", "op7_bpe", "op10_decontamination"])
def test_row_operators_do_not_shuffle(spark, name):
    text = QUERIES[name](spark, SMALL_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "MapInArrow" in text
