"""Registered queries against their SQL, and their results' shape where SQL can't say them."""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as spark_entry
from stratalake.llm.queries import QUERIES, SQL

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, con, name):
    ok, note, _, _ = compare(spark, con, name, SF_DIR)
    assert ok, note


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(spark_entry.queries()) and set(SQL) <= set(spark_entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op2_histogram_sort", "op5_concatenate_and_cut", "op7_rule_ensemble"])
def test_every_document_is_in_the_result(spark, name):
    rows = spark_entry.queries()[name](spark, SF_DIR)
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert {r.doc_id for r in rows.select("doc_id").collect()} == {r.doc_id for r in documents.select("doc_id").collect()}
