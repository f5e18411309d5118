"""Queries that SQL can express, against DuckDB on the driver's tables."""

import os

import duckdb
import pytest

from staylink.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"create view {file.removesuffix('.parquet')} as select * from '{SF}/{file}'")
    want = con.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    # values, not pandas columns: those turn a nullable count into a float on one side alone
    assert sorted(repr(tuple(r)) for r in got.select(columns).collect()) == sorted(map(repr, want.select(*columns).fetchall()))
