"""Every catalogue query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, _rows

ROOT = "/root/testdata/sf0.001"
QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{ROOT}/{table}.parquet'")
    return connection


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, ROOT)
    rows = df.collect()
    got = {c: [r[c] for r in rows] for c in df.columns}
    cursor = con.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    fetched = cursor.fetchall()
    want = {c: [r[i] for r in fetched] for i, c in enumerate(columns)}
    assert _rows(got) == _rows(want)


def test_lookup_with_small_arrays_equals_sql(spark, con):
    df = QUERIES["lookup"](spark, ROOT, max_array=3)
    want = con.execute(ORACLE["lookup"]).fetchall()
    assert max(row[2] for row in want) > 3
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
