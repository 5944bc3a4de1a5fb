"""All registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from verification.check import TABLES, compare
from verification.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    same, _, _, note = compare(spark, con, sf, name)
    assert same, note


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)
