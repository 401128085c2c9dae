"""Every registered query against its SQL, on whole tables."""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as spark_entry
from stratalake.registry import QUERIES, SQL

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    ok, note, _, _ = compare(spark, con, name, SF_DIR)
    assert ok, note


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert set(SQL) <= set(spark_entry.oracle_sql()) and set(QUERIES) <= set(spark_entry.queries())


def test_flagship(spark):
    df = spark_entry.entry(spark)
    assert "pct_of_day" in df.columns
    assert df.count() > 0
