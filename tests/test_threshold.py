"""Whole-catalogue lists for any scorer, and what may be left out before picking."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_ranking import CANDIDATE, all_requests, brute_mmr, likeness, rerank
from vitrine.operators import diversity as D
from vitrine.operators import ranking as R
from vitrine.operators import threshold


def personal(pairs):
    """A scorer that depends on user and product, with ties."""
    chance = F.pmod(F.xxhash64("user_id", "product_id"), F.lit(40)) / 39.0
    return pairs.withColumn("propensity_score", chance)


NAMES = [
    "user_id", "rank", "product_id", "pick_score", "final_score", "propensity_score", "weights_used", "total_candidates",
]


def picks(table):
    return sorted(tuple(r[n] for n in NAMES) for r in table.collect())


@pytest.mark.parametrize("diverse", [True, False])
@pytest.mark.parametrize("preset, top_k, first", [("balanced", 3, 4), ("lenskart", 12, 7), ("amazon", 20, 64)])
def test_equals_scoring_every_pair(shop, shelf, preset, top_k, first, diverse):
    """A pool as large as the shop scores every pair."""
    asked = all_requests(shop, candidate_pool=50, apply_diversity=diverse, weight_preset=preset, top_k=top_k)
    expected = picks(R.recommend(asked, shop["users"], shelf, personal))
    got = threshold.recommend_scored(asked, shop["users"], shelf, personal, first=first)
    assert picks(got) == expected


def test_mixed_requests_and_early_stop(shop, shelf):
    """Where the known part decides, blocks at the end are not scored."""
    seen = []

    def flat(pairs):
        seen.append(pairs.count())
        return pairs.withColumn("propensity_score", F.lit(0.5))

    asked = all_requests(shop, candidate_pool=50, top_k=2, apply_diversity=False)
    asked = asked.withColumn("weight_preset", F.when(F.col("user_id") < "u050", "clearance").otherwise("dyson"))
    got = picks(threshold.recommend_scored(asked, shop["users"], shelf, flat, highest=0.5, first=4))
    assert got == picks(R.recommend(asked, shop["users"], shelf, lambda p: p.withColumn("propensity_score", F.lit(0.5))))
    assert sum(seen) < 100 * 50


def test_diverse_lists_stop_early(shop, shelf):
    """Penalties push the picks down, but only cells that could be picked are gone down."""
    seen = []

    def flat(pairs):
        seen.append(pairs.count())
        return pairs.withColumn("propensity_score", F.lit(0.5))

    asked = all_requests(shop, candidate_pool=50, top_k=5, apply_diversity=True)
    highest = F.when(F.col("category") == "Home", 0.5).otherwise(F.lit(0.5))
    got = picks(threshold.recommend_scored(asked, shop["users"], shelf, flat, highest=highest, first=1))
    assert got == picks(R.recommend(asked, shop["users"], shelf, lambda p: p.withColumn("propensity_score", F.lit(0.5))))
    assert sum(seen) < 25 * 100


def test_no_requests(shop, shelf):
    asked = all_requests(shop).where("false")
    table = threshold.recommend_scored(asked, shop["users"], shelf, personal)
    assert table.columns == R.recommend(asked, shop["users"], shelf, personal).columns and table.count() == 0


@pytest.mark.parametrize("k, weight", [(1, 0.0), (4, 0.15), (9, 0.25)])
def test_pruning_keeps_all_that_can_be_picked(spark, k, weight):
    """Groups of thousands of rows: the same picks as the plain loop over all of them."""
    r = random.Random(k)
    pools = [
        [
            (g, i, round(r.random() ** 3, 6), r.randrange(5), r.choice("ab"), r.randrange(5))
            for i in range(r.choice([3, 400, 1500]))
        ]
        for g in range(6)
    ]
    table = spark.createDataFrame([row for pool in pools for row in pool], CANDIDATE)
    got = rerank(table, k, weight)
    for g, pool in enumerate(pools):
        assert [x[:2] for x in got[g]] == [x[:2] for x in brute_mmr(pool, k, weight)]
    kept = D.prune(table, "g", F.lit(k), F.lit(weight), F.lit(True), cells=True)
    assert kept.count() < sum(map(len, pools)) / 2
    plain = D.prune(table, "g", F.lit(k), F.lit(weight), F.lit(False))
    assert plain.count() == sum(min(k, len(pool)) for pool in pools)


@pytest.mark.parametrize("n, above", [(5, 0.3), (3, 0.2), (4, 0.1), (40, 0.0)])
def test_similar_products_below_a_shared_cluster(spark, n, above):
    r = random.Random(n)
    rows = [(i, r.choice([1, 1, 2, 3, 4]), r.choice("aab"), r.choice([10.0, 60.0, 200.0, 900.0])) for i in range(110)]
    table = spark.createDataFrame(rows, "product_id int, style_cluster int, category string, current_price double")
    tier = {10.0: 0, 60.0: 1, 200.0: 2, 900.0: 4}
    expected = {}
    for a in rows:
        options = []
        for b in rows:
            same = likeness((0, 0, 0, a[1], a[2], tier[a[3]]), (0, 0, 0, b[1], b[2], tier[b[3]]))
            if a[0] != b[0] and same > above:
                options.append((-same, b[0]))
        expected[a[0]] = [(i, -v) for v, i in sorted(options)[:n]]
    got = {}
    for row in sorted(D.similar_products(table, n, above).collect(), key=lambda x: (x.product_id, x.place)):
        got.setdefault(row.product_id, []).append((row.similar_id, row.similarity))
    assert got == {k: v for k, v in expected.items() if v}


def test_only_opened_products_are_sent(shop, shelf, monkeypatch):
    """Each round sent the whole catalogue to all executors, through the driver."""
    made, stage = [], threshold.stage
    monkeypatch.setattr(threshold, "stage", lambda table, name: made.append((name, stage(table, name))) or made[-1][1])

    def flat(pairs):
        # Requests are merged with what they opened, however few bytes that has in its files.
        assert "strategy=merge" in pairs._jdf.queryExecution().analyzed().toString()
        return pairs.withColumn("propensity_score", F.lit(0.5))

    asked = all_requests(shop, candidate_pool=50, top_k=2, apply_diversity=False)
    threshold.recommend_scored(asked, shop["users"], shelf, flat, highest=0.5, first=1)
    sizes = [table.count() for name, table in made if name == "round_items"]
    assert sizes and 0 < max(sizes) < shelf.count()
