"""What queries write on their way."""

import pytest
from conftest import SMALL

from fixwright.catalog import QUERIES, runner
from fixwright.catalog.workspace import Workspace


@pytest.mark.parametrize("name", ["distinct_sources", "identity_screen", "provider_summary", "archive_coverage"])
def test_one_pass_writes_no_archive(spark, name):
    ws = Workspace(spark, SMALL)
    assert QUERIES[name](ws).count() > 0
    assert not {"observations", "rows", "prepared"} & set(ws._kept)


def test_quotes_are_not_written_under_every_version(spark):
    ws = Workspace(spark, SMALL)
    assert QUERIES["restated_quotes"](ws).count() > 0
    assert not {"observations", "prepared"} & set(ws._kept)


def test_an_archive_on_file_is_read_again(spark):
    ws = Workspace(spark, SMALL)
    planned = ws.scan()
    rows = ws.rows()
    assert ws.scan() is rows and ws.rows() is rows
    by_run = ws.observations()
    assert ws.rows() is by_run and ws.scan() is by_run
    columns = sorted(planned.columns)
    assert by_run.select(columns).exceptAll(planned.select(columns)).isEmpty()
    assert planned.select(columns).exceptAll(by_run.select(columns)).isEmpty()


def test_stages_stay_within_what_the_jvm_compiles(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    runner("distinct_sources")(spark, SMALL)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8_000


@pytest.mark.parametrize("name", ["audit", "dangling_snapshots", "verify_summary", "robustness"])
def test_reading_every_run_needs_no_archive_by_run(spark, name):
    ws = Workspace(spark, SMALL)
    QUERIES[name](ws).count()
    assert "observations" not in ws._kept


@pytest.mark.parametrize("name", ["audit", "verify_summary", "impact_summary"])
def test_the_tape_takes_its_values_from_votes_already_counted(spark, name):
    ws = Workspace(spark, SMALL)
    QUERIES[name](ws).count()
    assert list(ws._plans) == ["every"] and "owned-screened" not in ws._kept
