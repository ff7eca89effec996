"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as E
from tools.check_queries import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert compare(E.queries()[name](spark, SF), duck, E.oracle_sql()[name]) == ""


def test_oracles_name_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry(spark):
    assert E.entry(spark).count() > 0
