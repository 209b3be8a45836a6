"""Distributed order, samples and joins against brute force, on hot data and any partitioning."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import drift, metrics, sampling
from vitrine.operators.ordering import dense_index, lowest_by_hash, running_totals
from vitrine.operators.skew import hot_keys, keyed_join, lookup_join, salted_join, size_in_bytes


def digest(value):
    return hashlib.md5(str(value).encode()).hexdigest()


@pytest.fixture(scope="module")
def hot_rows(spark):
    """A third of the rows, and more, on one key; some rows without a key."""
    rows = [(i, 7 if i % 2 else (None if i % 10 == 0 else i % 200)) for i in range(5000)]
    return spark.createDataFrame(rows, "row_no int, k int")


@pytest.fixture(scope="module")
def keyed_table(spark):
    return spark.createDataFrame([(k, f"v{k}") for k in range(0, 150)], "k int, v string")


def test_hot_keys_found(hot_rows):
    found = hot_keys(hot_rows, "k").collect()
    assert [r.hot_key for r in found] == [7]
    # Half of the rows are about four of the eight partitions; each gets two salts.
    assert 7 <= found[0].salts <= 8


@pytest.mark.parametrize(
    "text, size",
    [("10485760", 10 << 20), ("10MB", 10 << 20), ("10m", 10 << 20), ("1g", 1 << 30), ("-1", -1), ("64KiB", 64 << 10), ("5b", 5)],
)
def test_size_settings(text, size):
    assert size_in_bytes(text) == size


def spread_of(spark, rows, table, partitions, unique=None):
    """Largest part of the hot key's rows that one partition gets."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": str(partitions),
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = salted_join(rows, table, "k", unique=unique).filter("k = 1")
        counts = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return max(counts) / sum(counts), sum(counts)


def test_one_percent_of_the_rows_is_spread(spark):
    rows = spark.range(200_000).select(
        "id", F.when(F.col("id") % 100 == 0, 1).otherwise(1000 + F.col("id") % 50_000).cast("int").alias("k")
    )
    table = spark.createDataFrame([(1, "x"), (1001, "y")], "k int, v string")
    largest, total = spread_of(spark, rows, table, 400)
    assert total == 2000 and largest < 0.5


def test_equal_rows_are_spread_by_a_unique_column(spark):
    rows = spark.range(20_000).select(F.col("id").alias("event_id"), F.lit(1).alias("k"), F.lit("same").alias("x"))
    table = spark.createDataFrame([(1, "x")], "k int, v string")
    largest, total = spread_of(spark, rows, table, 32, unique="event_id")
    assert total == 20_000 and largest < 0.3


def test_no_hot_keys_in_even_rows(spark):
    rows = spark.range(100_000).select((F.col("id") % 5000).alias("k"))
    assert hot_keys(rows, "k").count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_join(hot_rows, keyed_table, how):
    expected = sorted(hot_rows.join(keyed_table, "k", how).collect(), key=repr)
    got = salted_join(hot_rows, keyed_table, "k", how)
    assert sorted(got.select(*hot_rows.join(keyed_table, "k", how).columns).collect(), key=repr) == expected


def test_salted_join_spreads_the_hot_key(spark, hot_rows, keyed_table):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = keyed_join(hot_rows, keyed_table, "k")
        spread = joined.filter("k = 7").groupBy(F.spark_partition_id()).count().count()
        plain = hot_rows.join(keyed_table, "k").filter("k = 7").groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plain == 1
    assert spread > 4


def test_lookup_join_both_ways(monkeypatch, hot_rows, keyed_table):
    expected = sorted(hot_rows.join(keyed_table, "k", "left").collect(), key=repr)
    assert sorted(lookup_join(hot_rows, keyed_table, "k", "left").collect(), key=repr) == expected
    monkeypatch.setattr("vitrine.sources.staging.MAX_BROADCAST_BYTES", 0)
    assert sorted(lookup_join(hot_rows, keyed_table, "k", "left").collect(), key=repr) == expected


def test_dense_index(spark):
    keys = [f"P{i:05d}" for i in range(500)]
    random.Random(1).shuffle(keys)
    table = spark.createDataFrame([(k,) for k in keys], "product_id string").repartition(5)
    got = {r.product_id: r.n for r in dense_index(table, "product_id", "n").collect()}
    expected = {k: i for i, k in enumerate(sorted(keys, key=lambda k: (digest(k)[:4], k)))}
    assert got == expected


@pytest.mark.parametrize("n", [0, 1, 10, 299, 300, 1000])
def test_lowest_by_hash(spark, n):
    table = spark.range(300).repartition(4)
    got = {r.id for r in table.filter(lowest_by_hash(table, "id", n)).collect()}
    assert got == set(sorted(range(300), key=digest)[:n])


def test_lowest_by_hash_inside_one_slice(spark, monkeypatch):
    monkeypatch.setattr("vitrine.operators.ordering.SLICE_DIGITS", 1)
    table = spark.range(300)
    got = {r.id for r in table.filter(lowest_by_hash(table, "id", 137)).collect()}
    assert got == set(sorted(range(300), key=digest)[:137])


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_running_totals(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        rows = [(f, v, (v * 7) % 5 + 1) for f in ("a", "b") for v in range(400)]
        random.Random(2).shuffle(rows)
        table = spark.createDataFrame(rows, "f string, v int, n int")
        got = running_totals(table, ["v"], ["n"], within=["f"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(got) == 800
    for row in got:
        assert row.n_before == sum((v * 7) % 5 + 1 for v in range(row.v))


def test_auc_with_ties_and_hot_score(spark):
    random.seed(3)
    rows = [(0.5 if i % 3 == 0 else round(random.random(), 2), int(random.random() < 0.4)) for i in range(600)]
    table = spark.createDataFrame(rows, "score double, label int").repartition(6)
    positives = [s for s, y in rows if y]
    negatives = [s for s, y in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in positives for n in negatives)
    got = metrics.auc(table, "score", "label").first()
    assert got.auc == pytest.approx(wins / (len(positives) * len(negatives)))


def test_auc_of_one_class_is_null(spark):
    table = spark.createDataFrame([(0.1, 1), (0.2, 1)], "score double, label int")
    assert metrics.auc(table, "score", "label").first().auc is None


@pytest.mark.parametrize("bins", [4, 10])
def test_quantile_edges_match_numpy(spark, bins):
    rng = np.random.default_rng(4)
    data = {
        "normal": rng.normal(size=777),
        "skewed": np.exp(rng.normal(size=501) * 3),
        "steps": rng.integers(0, 6, size=640).astype(float),
        "constant": np.full(50, 5.0),
        "single": np.array([2.5]),
    }
    rows = [(name, float(v)) for name, values in data.items() for v in values]
    random.Random(5).shuffle(rows)
    values = spark.createDataFrame(rows, "feature string, value double").repartition(5)
    got = {r.feature: r.edges for r in drift.quantile_edges(values, bins).collect()}
    for name, column in data.items():
        expected = np.unique(np.percentile(column, np.linspace(0, 100, bins + 1)))
        assert got[name] == pytest.approx(list(expected))


def test_histogram_matches_numpy(spark):
    values = spark.createDataFrame([("x", v) for v in (0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 4.5)], "feature string, value double")
    edges = spark.createDataFrame([("x", [1.0, 2.0, 4.0])], "feature string, edges array<double>")
    got = sorted((r.bin_no, r.n, r.share) for r in drift.histogram(values, edges).collect())
    assert got == [(1, 2, 0.4), (2, 3, 0.6)]


def pools(spark, users, n_products):
    requests = spark.range(users).select(F.col("id").alias("user_id"), F.lit(500).alias("candidate_pool"))
    found = {}
    for row in sampling.with_candidates(requests, n_products).collect():
        found.setdefault(row.user_id, []).append(row.product_index)
    return found


@pytest.mark.parametrize("n_products", [1, 5, 97, 7919, 7919 * 2, 7919 * 104729 * 1299709])
def test_candidates_are_distinct(spark, n_products):
    found = pools(spark, 50, n_products)
    assert len(found) == 50
    for positions in found.values():
        assert len(positions) == len(set(positions)) == min(500, n_products)
        assert all(0 <= i < n_products for i in positions)
