"""Queries that SQL can express, against DuckDB on the small tables."""
import duckdb
import pytest

from quizspark.llm import queries as q

SF_SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    df = q.QUERIES[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    want = con.sql(q.oracle_sql()[name])
    assert sorted(want.columns) == cols
    rows = con.sql(f"SELECT {', '.join(cols)} FROM ({q.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in df.select(*cols).collect())
