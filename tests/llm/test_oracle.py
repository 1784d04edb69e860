"""The queries that SQL can express, on the smallest tables."""

import os

import pytest

from corpusveil.llm import oracle, queries
from tests.oracle import DATA, assert_same


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", list(oracle.ORACLE_SQL))
def test_query(spark, name):
    assert_same(spark, queries.QUERIES[name], oracle.ORACLE_SQL[name])
