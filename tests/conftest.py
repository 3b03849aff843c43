import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def series(spark):
    """Build a (k, x, y) DataFrame from {key: (xs, ys)}."""

    def build(data, key="k"):
        rows = [
            (k, float(x), float(y)) for k, (xs, ys) in data.items() for x, y in zip(xs, ys)
        ]
        return spark.createDataFrame(rows, f"{key} string, x double, y double")

    return build


def collect(df, *order):
    """Rows as tuples, sorted by the given columns."""
    return [tuple(r) for r in df.orderBy(*order).collect()]
