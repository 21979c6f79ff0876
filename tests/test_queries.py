"""Every registered query gives the rows of its SQL twin."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from suite.oracle import ORACLE
from suite.spark_queries import QUERIES
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_a_twin():
    assert QUERIES.keys() == ORACLE.keys()
    assert contract.queries().keys() >= QUERIES.keys()
    assert contract.oracle_sql().keys() >= ORACLE.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    assert difference(df, duck, contract.oracle_sql()[name]) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["tag_id", "tag_name", "similarity", "rank"]
    assert df.count() == 20
