"""Registered queries of the text operators against their SQL on the smallest data set."""

import glob
import os

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as driver
from fixwright.llm import queries

OPS = {f"op{i}_" for i in range(1, 14)}


def test_every_operator_has_its_query():
    names = driver.queries()
    assert all(sum(n.startswith(p) for n in names) == 1 for p in OPS) and "pipeline" in names
    assert set(queries.SQL) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = driver.queries()[name](spark, SMALL)
    cur = con.execute(queries.SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, cur.fetchall()))
