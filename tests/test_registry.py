"""Every registered query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from check import TABLES, rows_of
from registry import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def test_oracle_names():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    got = rows_of(df.columns, df.collect())
    assert got
    if name in ORACLE:
        result = db.execute(ORACLE[name])
        names = [d[0] for d in result.description]
        assert sorted(df.columns) == sorted(names)
        assert got == rows_of(names, result.fetchall())
