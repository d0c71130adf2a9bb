"""Each operator that SQL can express equals it over whole tables."""

import glob
import os

import duckdb
import pytest

from weftline.llm import queries

DATA = "/root/testdata/sf0.01"


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple("null" if r[i] is None else f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    a, b = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLES[name])
    assert sorted(a.columns) == sorted(b.columns)
    got = plain(a.collect(), a.columns)
    assert got and got == plain(b.fetchall(), b.columns)
