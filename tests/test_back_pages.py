"""What it takes to read the pages of the back-series job."""

from conftest import SMALL
from pyspark.sql import functions as F

from fixwright.catalog import backpages
from fixwright.catalog.workspace import Workspace
from fixwright.functions import markup


def test_a_page_is_made_visible_once(spark):
    page = spark.range(1).select(F.lit("<p>a<noscript><p>b</noscript><p>c").alias("html"))
    df = page.select(markup.cells("html").alias("cells"))
    assert df._jdf.queryExecution().analyzed().toString().count("<!--") == 1
    assert df.first().cells == ["a", "c"]


def test_pages_of_the_job_are_written_before_they_are_read(spark):
    ws = Workspace(spark, SMALL)
    assert backpages._job(ws).manifest.inputFiles()
    assert all("/pages-" in f for f in ws._kept["back-series"].manifest.select("sha256").inputFiles() if "restated" not in f)
