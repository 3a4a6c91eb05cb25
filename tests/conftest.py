import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def columns_table(spark):
    """A text table from columns of any length; shorter ones end in missing cells."""

    def build(columns):
        length = max(len(v) for v in columns.values())
        rows = [
            (i, *[(v[i] if i < len(v) else None) for v in columns.values()]) for i in range(length)
        ]
        schema = "row_id bigint, " + ", ".join(f"`{n}` string" for n in columns)
        return spark.createDataFrame(rows, schema).coalesce(1)

    return build
