"""Every registered query against its SQL twin in DuckDB, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points

duckdb = pytest.importorskip("duckdb")

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def canonical(rows, order):
    value = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    got = [tuple(r) for r in df.collect()]
    columns = sorted(df.columns)
    if name not in SQL:
        assert got
        return
    result = duck.execute(SQL[name])
    kinds = {c[0]: str(c[1]) for c in result.description}
    assert columns == sorted(kinds)
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == kinds
    names = [c[0] for c in result.description]
    want = canonical(result.fetchall(), [names.index(c) for c in columns])
    assert canonical(got, [df.columns.index(c) for c in columns]) == want


def test_entry(spark):
    rows = entry_points.entry(spark)
    assert rows.columns[:2] == ["query_id", "citation"] and rows.count() > 0
