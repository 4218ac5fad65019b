"""One local session for all tests, with its own scratch folder."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    scratch = tmp_path_factory.mktemp("feedlake")
    session = (
        SparkSession.builder.master("local[8]")
        .appName("feedlake-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(scratch / "shared"))
        .config("spark.sql.warehouse.dir", str(scratch / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Apply a Column function to one string column; results in input order."""

    def run(fn, items, schema="string"):
        rows = [(i, v) for i, v in enumerate(items)]
        df = spark.createDataFrame(rows, f"i int, v {schema}")
        from pyspark.sql import functions as F

        out = df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()
        return [row.r for row in out]

    return run
