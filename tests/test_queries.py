"""Every registered query that has SQL, against that SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from tests.compare import connect, difference
from vitrine.plans.oracle import statements

FOLDER = "/root/testdata/sf0.001"
SQL = statements()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_statement_belongs_to_a_query():
    assert set(SQL) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    mine = contract.queries()[name](spark, FOLDER).toArrow()
    assert difference(mine, duck.sql(SQL[name]).to_arrow_table()) == ""
