"""Every query of the star schema against its SQL, on the smallest tables. Those of
the subpackage for corpora have their own tests."""

import os

import pytest
from checks.compare import oracle_rows, spark_rows, tables
from checks.oracle import oracle_sql
from checks.queries import QUERIES

import __spark_entry__ as contract

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def database():
    return tables(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracle_sql())
    assert set(QUERIES) <= set(contract.queries()) and set(QUERIES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    columns, got = spark_rows(QUERIES[name](spark, SF_DIR))
    want_columns, want = oracle_rows(database, oracle_sql()[name])
    assert columns == want_columns
    assert got == want


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and df.columns[0] == "order_id"
