"""Every registered query beside its SQL on the smallest given tables."""

import pytest

import __spark_entry__ as registered
from checks import queries
from checks.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(queries.QUERIES) <= set(registered.oracle_sql())


def test_entry(spark):
    assert registered.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, con, name):
    assert difference(spark, con, SF, registered.queries()[name], registered.oracle_sql()[name]) is None
