"""Registered queries against their SQL, on the smallest test folder."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry_points
from check_queries import compare
from spokeworks.checks.catalog import CATALOG

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in pathlib.Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return connection


@pytest.mark.parametrize("name", CATALOG)
def test_query(spark, duck, name):
    rows = entry_points.queries()[name](spark, FOLDER).toArrow()
    assert compare(rows, duck.sql(entry_points.oracle_sql()[name]).to_arrow_table()) == ""


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["date", "location", "year", "day_type", "metric_name", "metric_value"]


def test_every_query_has_sql():
    assert CATALOG.keys() <= entry_points.queries().keys()
    assert CATALOG.keys() <= entry_points.oracle_sql().keys()
