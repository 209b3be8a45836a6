"""Scalar rules on literal rows, with the values written out."""

import pytest
from pyspark.sql import functions as F

from vitrine import fixed
from vitrine.functions import scalars as S
from vitrine.functions import vectors as V


def column_of(spark, values, kind, build):
    table = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = table.select("i", build(F.col("v")).alias("r")).collect()
    return [row.r for row in sorted(rows, key=lambda row: row.i)]


def test_urgency_and_badge_edges(spark):
    scores = [0.0, 0.349, 0.35, 0.649, 0.65, 0.70, 0.849, 0.85, 0.9]
    assert column_of(spark, scores, "double", S.urgency_label) == [
        "Low", "Low", "Medium", "Medium", "High", "High", "High", "Critical", "Critical",
    ]
    assert column_of(spark, scores, "double", S.sale_badge) == [False] * 4 + [True] * 5


def test_price_tier_edges(spark):
    prices = [-1.0, 0.0, 49.99, 50.0, 150.0, 350.0, 700.0]
    assert column_of(spark, prices, "double", S.price_tier) == [4, 0, 0, 1, 2, 3, 4]


def test_codes_and_unknown_labels(spark):
    assert column_of(spark, ["New", "Lapsed", "Regular", "VIP", "Other", None], "string", S.segment_code) == [
        0, 1, 2, 3, 0, 0,
    ]
    encode = lambda c: S.encode(c, fixed.CATEGORY_CODES)
    assert column_of(spark, ["Eyewear", "Sports", "Beauty", "Toys", None], "string", encode) == [0, 5, 4, 0, 0]


def test_rounding_is_decimal(spark):
    assert column_of(spark, [1.005, 0.285, 2.675], "double", lambda c: S.rnd(c, 2)) == [1.01, 0.29, 2.68]
    # A sum that is a hair under the tie counts as the tie.
    assert column_of(spark, [0.1 + 0.7 + 0.0049999999999999], "double", lambda c: S.rnd(c, 2)) == [0.81]


def test_treatment_arm(spark):
    assert column_of(spark, [0.0, 0.049, 0.05, 0.3], "double", S.treatment_arm) == [0, 0, 1, 1]


def test_stock_and_margin_rules(spark):
    rows = spark.createDataFrame(
        [(100, 25, 10.0, 4.0), (0, 5, 0.0, 1.0), (10, 20, 5.0, 6.0)],
        "initial int, current int, price double, cost double",
    )
    got = rows.select(
        S.sell_through_rate(F.col("initial"), F.col("current")).alias("s"),
        S.margin_score(F.col("price"), F.col("cost")).alias("m"),
    ).collect()
    assert [tuple(r) for r in got] == [(0.75, 0.6), (0.0, 0.0), (0.0, 0.0)]


def test_affinity_boost_stops_at_one(spark):
    boost = lambda c: S.boosted_affinity(F.lit(0.8), "Home", c)
    assert column_of(spark, ["Home", "Sports", None], "string", boost) == [1.0, 0.8, 0.8]


def test_time_features(spark):
    days = spark.sql("select date'2024-01-01' as d union all select date'2024-01-06'")
    parts = S.time_features(F.col("d"))
    got = days.select(*[c.alias(n) for n, c in parts.items()]).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 0), (5, 1, 1)]


@pytest.mark.parametrize("length, expected", [(2, [1.0, 2.0]), (3, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 3.0, 0.0, 0.0])])
def test_pad_or_trim(spark, length, expected):
    row = spark.range(1).select(V.pad_or_trim(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), length).alias("v")).first()
    assert row.v == expected


def test_similarity_values(spark):
    def like(cluster, category, tier):
        own = {"cluster": F.lit(1), "category": F.lit("a"), "tier": F.lit(0)}
        other = {"cluster": F.lit(cluster), "category": F.lit(category), "tier": F.lit(tier)}
        return spark.range(1).select(S.similarity(own, other)).first()[0]

    assert like(1, "a", 0) == 1.0
    assert like(1, "a", 0) >= 0.8
    assert like(2, "b", 4) == 0.04
    assert like(1, "b", 2) == 0.62


def test_rounding_next_to_ties(spark):
    from decimal import ROUND_HALF_UP, Decimal

    values = [0.123449995, 0.12345, 0.1234499999, 0.12344999999999999, -0.12345, -0.123449995, 2.00005, 1e9 + 0.00005, 0.0, -0.0]
    values += [k / 20000 for k in range(1, 4000, 37)] + [(k + 0.4999999) / 10000 for k in range(50)]

    def exact(x):
        twelve = Decimal(repr(x)).quantize(Decimal("1e-12"), ROUND_HALF_UP)
        return float(twelve.quantize(Decimal("0.0001"), ROUND_HALF_UP))

    assert column_of(spark, values, "double", lambda c: S.rnd(c, 4)) == [exact(x) for x in values]


def test_rounding_of_what_fits_no_decimal(spark):
    got = column_of(spark, [1e25, float("inf"), None], "double", lambda c: S.rnd(c, 2))
    assert got == [1e25, float("inf"), None]
