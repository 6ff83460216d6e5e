"""Every registered query against its SQL on the smallest sample."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables are not there")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, (bool,)) or type(value).__name__ in ("bool", "bool_"):
        return str(bool(value))
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return ""
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    return repr(float(value)) if not isinstance(value, str) else value


def rows(frame):
    ordered = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in row) for row in ordered.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, sql, name):
    got = driver.queries()[name](spark, FOLDER).toPandas()
    expected = sql.execute(driver.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_entry(spark):
    assert driver.entry(spark).count() == 1
