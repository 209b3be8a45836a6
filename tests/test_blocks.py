"""Candidates from blocks of the catalogue, for one that is too large to broadcast."""

import pytest
from pyspark.sql import functions as F

from vitrine import fixed
from vitrine.operators import ranking as R
from vitrine.operators import sampling
from vitrine.sources import staging
from vitrine.sources.staging import stage


@pytest.fixture
def large(monkeypatch):
    """Any staged table counts as too large to broadcast, and blocks are short."""
    monkeypatch.setattr(staging, "MAX_BROADCAST_BYTES", -1)
    monkeypatch.setattr(sampling, "BLOCK", 8)


def picks(ranked):
    return sorted(tuple(row) for row in ranked.collect())


def asked(shop, **options):
    wanted = {"top_k": 7, "candidate_pool": 20, "weight_preset": "dyson", "apply_diversity": True, **options}
    users = shop["users"].select("user_id", F.concat(F.lit("r"), "user_id").alias("request_id"))
    return users.withColumns({n: v if hasattr(v, "alias") else F.lit(v) for n, v in wanted.items()})


@pytest.mark.parametrize("n_products", [1, 2, 7, 8, 9, 40, 41])
@pytest.mark.parametrize("longest", [1, 3, 20, 60])
def test_blocks_hold_the_walks(spark, monkeypatch, n_products, longest):
    monkeypatch.setattr(sampling, "BLOCK", 8)
    requests = spark.range(60).select(
        F.col("id").alias("user_id"), F.least(F.pmod("id", F.lit(61)), F.lit(longest)).cast("int").alias("candidate_pool")
    )
    products = stage(spark.range(n_products).select(F.col("id").alias("product_index")), "positions")
    met = sampling.with_blocks(requests, products, n_products, longest)
    got = {r.user_id: [i.product_index for i in r["items"]] for r in met.collect()}
    expected = {u: [] for u in range(60)}
    for r in sampling.with_candidates(requests, n_products).collect():
        expected[r.user_id].append(r.product_index)
    assert got == expected


def test_large_catalogue_gives_the_same_lists(shop, shelf, request):
    varied = asked(
        shop,
        weight_preset=F.when(F.col("user_id") < "u030", "clearance").otherwise("unlisted"),
        apply_diversity=F.col("user_id") < "u060",
        top_k=F.when(F.col("user_id") < "u045", 3).otherwise(100),
        candidate_pool=F.when(F.col("user_id") < "u020", 500).otherwise(15),
    )
    learned = lambda pairs: R.rated(pairs)  # not the default, so scored row by row
    small = picks(R.recommend(varied, shop["users"], shelf))
    request.getfixturevalue("large")
    assert picks(R.recommend(varied, shop["users"], shelf)) == small
    assert picks(R.recommend(varied, shop["users"], shelf, learned)) == small


def test_large_catalogue_shuffles_no_pairs(shop, shelf, large):
    """Requests, blocks, picks and the catalogue are moved; before, pairs were, twice."""
    plan = R.recommend(asked(shop), shop["users"], shelf)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    for moved in plan.split("Exchange hashpartitioning(")[1:]:
        assert not moved.startswith("product_index")
    rows = R.candidate_pairs(asked(shop), shelf, "request_id", R.SCORED, fixed.CANDIDATE_POOL[2])
    ranked = R.rank_by_score(rows, R.group_of(rows, "request_id"), "margin_score")
    moves = ranked._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(")
    assert moves == 2  # requests and blocks, by slot
