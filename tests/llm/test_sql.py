"""Registered text queries next to their SQL."""

import pytest

from tests.compare import connect, difference
from vitrine.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, connection, name):
    mine = QUERIES[name](spark, FOLDER).toArrow()
    assert mine.num_rows > 0
    assert difference(mine, connection.execute(SQL[name]).to_arrow_table()) == ""


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
