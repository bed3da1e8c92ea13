"""Every registered query against its SQL in DuckDB, values and column types."""

import os

import duckdb
import pytest

import __spark_entry__ as spark_entry
from tollbridge.queries.registry import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def key(row):
    return tuple((v is not None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = spark_entry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    expected = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({spark_entry.oracle_sql()[name]})")
    assert dict(zip(expected.columns, map(str, expected.types))) == {
        c: TYPES[t] for c, t in df.select(*columns).dtypes
    }
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
    wanted = sorted(expected.fetchall(), key=key)
    assert len(got) == len(wanted) and got == wanted
    assert wanted


def test_entry_gives_rows(spark):
    assert spark_entry.entry(spark).count() > 0
