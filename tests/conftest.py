import datetime as dt
import json
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NOW = dt.datetime(2026, 9, 1, tzinfo=dt.UTC)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.logging.maxLines", "0")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    """Lines of records (dicts, or texts as they are), numbered in order."""

    def make(*records):
        rows = [(r if isinstance(r, str) else json.dumps(r), k) for k, r in enumerate(records)]
        return spark.createDataFrame(rows, "line string, seq bigint")

    return make
