"""Columns of the input keep their values under whatever names."""

import random

import pytest

from tests.llm.conftest import SCHEMA, sentence
from vitrine.llm import jaccard, mixing

NAMES = ["text_key", "__key", "key", "row", "id", "runs", "copy", "pass", "first", "last", "node"]


@pytest.fixture(scope="module")
def named(spark):
    rng = random.Random(3)
    texts = [sentence(rng, 70) for _ in range(6)]
    rows = [(i, texts[i % 6], "en", f"s{i % 3}", None) for i in range(8)]
    table = spark.createDataFrame(rows, SCHEMA)
    return table.selectExpr("*", *[f"concat('{n} of ', doc_id) as `{n}`" for n in NAMES])


def check(rows, columns, named):
    assert rows and columns == named.columns
    for r in rows:
        assert all(r[n] == f"{n} of {r.doc_id}" for n in NAMES)


def test_mixed(named):
    table = mixing.mixed(named)
    check(table.collect(), table.columns, named)


def test_keep_one(named):
    table = jaccard.keep_one(named)
    rows = table.collect()
    check(rows, table.columns, named)
    assert sorted(r.doc_id for r in rows) == list(range(6))
