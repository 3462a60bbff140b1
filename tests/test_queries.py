"""Every registered query against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from omenlog.plans import load

FOLDER = "/root/testdata/sf0.001"
QUERIES = load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]

    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "null"
        return repr(float(v)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else repr(v)

    return sorted(tuple(plain(v) for v in r) for r in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    q = QUERIES[name]
    got = q.run(spark, FOLDER).toPandas()
    if q.sql is None:
        assert len(got) > 0
        return
    want = duck.execute(q.sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
