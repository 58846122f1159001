"""Every registered query equals its SQL counterpart on the test tables."""

import pytest

import __spark_entry__ as contract
from oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.01"
# the corpus queries have tests of their own
QUERIES = {k: v for k, v in contract.queries().items() if k not in contract.LLM_QUERIES}
ORACLE = {k: v for k, v in contract.oracle_sql().items() if k not in contract.LLM_ORACLE}


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, db, name):
    assert compare(QUERIES[name](spark, FOLDER), db, ORACLE[name]) == []


def test_entry(spark):
    assert contract.entry(spark).count() == 9
