"""Queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from assaylake.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rel = con.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(want)
