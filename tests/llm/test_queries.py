"""The registered queries against their SQL, or against plain code where SQL cannot say it."""

import os
import re
import zlib

import duckdb
import pandas as pd
import pytest

from omenlog.llm import simhash
from omenlog.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
NAMES = {int(re.match(r"op(\d+)_", n)[1]): n for n in QUERIES}


def read(name):
    return pd.read_parquet(os.path.join(FOLDER, f"{name}.parquet"))


def plain(pdf):
    cell = lambda v: "-" if v is None or v is pd.NA or v != v else str(int(v)) if hasattr(v, "dtype") or isinstance(v, int) else v
    return sorted(tuple(map(cell, r)) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


def test_numbered_operators():
    assert sorted(NAMES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{table}'")
    want = con.execute(SQL[name]).df()
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_whole_tables(spark):
    docs = read("documents")
    for n in (1, 2, 3, 5, 6, 9, 13):
        got = QUERIES[NAMES[n]](spark, FOLDER).select("doc_id").toPandas()
        assert sorted(got["doc_id"]) == sorted(docs["doc_id"]), n


def test_toxicity_held_out(spark):
    got = QUERIES[NAMES[1]](spark, "/root/testdata/sf0.01").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    known = got.merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    held = known[known["held_out"]]
    assert (held["predicted"] == held["toxic"]).mean() >= 0.9
    assert not (held["predicted"] > held["toxic"]).any()


def test_near_duplicates(spark):
    docs = read("documents")
    prints = {i: simhash.fingerprint(t) for i, t in zip(docs["doc_id"], docs["text"])}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES[NAMES[2]](spark, FOLDER).collect()}
    assert got == {i: (f"{p:016x}", find(i)) for i, p in prints.items()}


def test_shards(spark):
    got = QUERIES[NAMES[5]](spark, FOLDER).toPandas().set_index("doc_id")
    for r in read("documents").itertuples():
        assert got.loc[r.doc_id, "size"] == len(r.text.encode()) + 1 and got.loc[r.doc_id, "text_crc32"] == zlib.crc32(r.text.encode())
