import os
import shutil
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="trafficlens-test-")
    session = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4")
               .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", shared)
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.session.timeZone", "America/New_York").getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    yield session
    shutil.rmtree(shared, ignore_errors=True)


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def requests(spark, folder):
    """The request log of the smallest scale, stored once."""
    from trafficlens.operators.skew import materialize
    from trafficlens.plans.queries import requests
    return materialize(requests(spark, folder), "test-requests")


@pytest.fixture(scope="session")
def small_scale():
    """Settings that make ordinary sessions hot and chunks tiny."""
    from trafficlens.config import ScaleSettings, Settings
    return Settings(scale=ScaleSettings(hot_rows=60, chunk_rows=7))
