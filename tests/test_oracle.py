"""Every registered query against its DuckDB SQL on the sf0.001 tables (the driver's check, small)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from compare import TABLES, canon  # noqa: E402

from .conftest import SF001  # noqa: E402

from staylink.plans.oracle import oracle_sql  # noqa: E402
from staylink.plans.queries import QUERIES  # noqa: E402

NAMES = sorted(QUERIES)  # the training-data queries have tests of their own


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(oracle_sql()) and set(QUERIES) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["year", "n", "percent"] and df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    s = canon(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(E.oracle_sql()[name])
    d = canon([c[0] for c in res.description], res.fetchall())
    assert s[0] == d[0]
    assert s[1] == d[1]
