"""Every query with oracle SQL against DuckDB on the same Parquet tables; the others run."""

import os

import duckdb
import pytest

from ringframe.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(df):
    columns = sorted(df.columns)
    return columns, df[columns].sort_values(columns, ignore_index=True)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name not in queries.ORACLE:
        return
    want = duck.sql(queries.ORACLE[name]).df()
    (columns, a), (others, b) = rows(got), rows(want)
    assert columns == others and len(a) == len(b)
    for c in columns:
        if a[c].dtype.kind in "fi":
            assert a[c].astype(float).fillna(-1e99).tolist() == b[c].astype(float).fillna(-1e99).tolist(), c
        else:
            assert a[c].tolist() == b[c].tolist(), c
