"""Every query with SQL gives the same rows on the smallest given tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import rows_of

DIRECTORY = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="the given tables are missing")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{DIRECTORY}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, db, name):
    frame = entry.queries()[name](spark, DIRECTORY)
    result = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 13
