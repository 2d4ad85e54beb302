import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[8]").appName("tablekit-tests")
        .config("spark.sql.shuffle.partitions", "5").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tablekit-tests-"))
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def people(spark):
    """Row index, two text columns, numbers with gaps."""
    return spark.createDataFrame(
        [
            (0, "Ann", 31, 90.5, "active", None), (1, "Bob", 27, 71.0, "inactive", "x"),
            (2, "Cora", 45, None, "active", None), (3, "Dov", None, 88.0, None, "y"),
            (4, "Eve", 27, 96.25, "active", "z"), (5, "Ann", 31, float("nan"), "idle", "x"),
        ],
        "__row_index__ long, name string, age long, score double, status string, note string",
    )


def rows(df, *columns):
    """The rows as a list of tuples, in the order of the first column."""
    out = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))
