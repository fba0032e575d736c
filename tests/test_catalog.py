"""Registered queries against their SQL on the smallest data set, and the stream against the batch."""

import glob
import math
import os

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as driver

CHECKED = [
    "fixings", "contributions", "reject_counts", "commitment_evidence", "tape_asof_each", "feed_stall", "verify", "impact_summary",
    "implied_decline", "ladder_expectation", "page_cells", "priced_table", "embedded_prices", "period_series_month", "stream_feed_totals",
    "stream_fixings",
]


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 5) if isinstance(v, float) else str(v) if not isinstance(v, bool | int) else v


def test_every_query_is_registered_once_and_most_have_sql():
    names, sql = driver.queries(), driver.oracle_sql()
    assert set(sql) <= set(names) and len(names) >= 100


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = driver.queries()[name](spark, SMALL)
    cur = con.execute(driver.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    want = sorted(str([plain(v) for v in r]) for r in cur.fetchall())
    assert sorted(str([plain(v) for v in r]) for r in got.select(*[f"`{c}`" for c in cols]).collect()) == want


def test_entry_runs(spark):
    assert driver.entry(spark).count() > 0
