from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL_SF = os.environ.get("FERRY_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def scratch() -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.fixture(scope="session")
def spark(scratch):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .appName("ferry-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
        .config("spark.checkpoint.dir", os.path.join(scratch, "checkpoints"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def src(spark) -> str:
    """Source namespace built from the smallest scale factor."""
    from ferry.sources.testdata import source_schema_for

    return source_schema_for(spark, SMALL_SF)


@pytest.fixture()
def tgt(spark) -> str:
    """A fresh, empty target namespace per test."""
    from ferry.sources.testdata import fresh_schema

    return fresh_schema(spark, "t")
