import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


OBS = (
    "source string, source_sku string, gpu_model string, gpu_count int, usd_per_hour_total double, currency string, "
    "price_kind string, commitment string, form_factor string, interconnect string, vram_gb int, region string, "
    "tier int, machine_id bigint, host_id bigint, observed_at timestamp, snapshot string"
)


def quote(**over):
    """One quote that conforms to the H100 contract, with overrides."""
    row = {
        "source": "alpha", "source_sku": "a1", "gpu_model": "H100 SXM", "gpu_count": 8, "usd_per_hour_total": 24.0,
        "currency": "USD", "price_kind": "quoted", "commitment": "on_demand", "form_factor": "sxm",
        "interconnect": "nvlink", "vram_gb": 80, "region": "us-east-1", "tier": 2, "machine_id": None, "host_id": None,
        "observed_at": dt.datetime(2026, 8, 27, 12), "snapshot": "run-1",
    }
    row.update(over)
    return row


@pytest.fixture(scope="session")
def observations(spark):
    def build(rows):
        names = [f.split()[0] for f in OBS.split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], OBS)

    return build
