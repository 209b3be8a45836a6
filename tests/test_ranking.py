"""Ranking, diversity, cold start and A/B rules on the small shop and on literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from vitrine import fixed
from vitrine.operators import diversity as D
from vitrine.operators import experiments as X
from vitrine.operators import features as U
from vitrine.operators import ranking as R
from vitrine.operators import sampling
from vitrine.sources.staging import stage
from vitrine.streaming import serving

CANDIDATE = "g int, product_id int, score double, cluster int, category string, tier int"


def likeness(a, b):
    return round(0.5 * (a[3] == b[3]) + 0.3 * (a[4] == b[4]) + 0.2 * (1 - abs(a[5] - b[5]) / 5), 4)


def brute_mmr(pool, k, weight):
    """Plain loop over (g, id, score, cluster, category, tier) rows of one group."""
    left, picks = sorted(pool, key=lambda c: (-c[2], c[1])), []

    def penalty(c, others):
        return max([round(weight * likeness(c, o), 4) for o in others], default=0.0)

    while left and len(picks) < k:
        values = [c[2] - penalty(c, [p for p, _ in picks]) for c in left]
        at = values.index(max(values))
        picks.append((left.pop(at), values[at]))
    result = []
    for rank, (c, value) in enumerate(picks, 1):
        others = [p for p, _ in picks if p is not c]
        result.append((rank, c[1], value, round(max(0.0, c[2] - penalty(c, others)), 6)))
    return result


def rerank(table, k, weight):
    rows = D.mmr_rerank(table, "g", F.lit(k), F.lit(weight)).collect()
    found = {}
    for row in sorted(rows, key=lambda r: (r.g, r.rank)):
        found.setdefault(row.g, []).append((row.rank, row.product_id, row.pick_score, row.final_score))
    return found


def test_mmr_on_written_out_rows(spark):
    rows = [
        (1, 1, 0.90, 7, "1", 0), (1, 2, 0.85, 7, "1", 0), (1, 3, 0.80, 8, "1", 1), (1, 4, 0.78, 9, "2", 4),
        (2, 5, 0.5, 1, "1", 1), (2, 6, 0.5, 2, "2", 2),
    ]
    got = rerank(spark.createDataFrame(rows, CANDIDATE), 3, 0.15)
    assert [p for _, p, _, _ in got[1]] == [1, 4, 3]
    assert [p for _, p, _, _ in got[2]] == [5, 6]


@pytest.mark.parametrize("k, weight", [(1, 0.15), (5, 0.15), (20, 0.25), (100, 0.1)])
def test_mmr_equals_the_loop(spark, k, weight):
    r = random.Random(k)
    pools = [
        [
            (g, i, round(r.choice([0.2, 0.4, r.random()]), 6), r.randrange(4), r.choice("abc"), r.randrange(5))
            for i in r.sample(range(1000), r.randint(1, 60))
        ]
        for g in range(40)
    ]
    table = spark.createDataFrame([row for pool in pools for row in pool], CANDIDATE).repartition(7)
    got = rerank(table, k, weight)
    for g, pool in enumerate(pools):
        expected = brute_mmr(pool, k, weight)
        assert [x[:2] for x in got[g]] == [x[:2] for x in expected]
        for mine, theirs in zip(got[g], expected):
            assert mine[2] == pytest.approx(theirs[2]) and mine[3] == pytest.approx(theirs[3])


def test_mmr_over_more_rows_than_a_chunk(spark, monkeypatch):
    rows = [(g, i, (i * 37 % 11) / 10, i % 3, "a", i % 5) for g in range(2000) for i in range(g % 7 + 1)]
    got = rerank(spark.createDataFrame(rows, CANDIDATE).coalesce(1), 4, 0.2)
    assert len(got) == 2000
    for g in (0, 255, 256, 1999):
        expected = brute_mmr([row for row in rows if row[0] == g], 4, 0.2)
        assert [x[1] for x in got[g]] == [x[1] for x in expected]


def test_penalty_grows_with_weight_and_starts_at_zero(shelf):
    ranked = shelf.limit(5).withColumns({"g": F.lit(1), "rank": F.monotonically_increasing_id() + 1})
    ranked = stage(ranked, "five")
    low = D.diversity_penalties(ranked, "g", F.lit(0.1)).orderBy("rank").collect()
    high = D.diversity_penalties(ranked, "g", F.lit(0.3)).orderBy("rank").collect()
    assert low[0].diversity_penalty == 0.0
    assert all(b.diversity_penalty >= a.diversity_penalty for a, b in zip(low, high))
    assert any(b.diversity_penalty > a.diversity_penalty for a, b in zip(low, high))


@pytest.mark.parametrize("n, above", [(5, 0.5), (2, 0.75), (30, 0.5)])
def test_similar_products_equals_all_pairs(spark, n, above):
    r = random.Random(n)
    rows = [(i, r.choice([1, 1, 2, 3]), r.choice("ab"), r.choice([10.0, 60.0, 200.0, 900.0])) for i in range(120)]
    table = spark.createDataFrame(rows, "product_id int, style_cluster int, category string, current_price double")
    tier = {10.0: 0, 60.0: 1, 200.0: 2, 900.0: 4}
    expected = {}
    for a in rows:
        options = []
        for b in rows:
            value = likeness((0, 0, 0, a[1], a[2], tier[a[3]]), (0, 0, 0, b[1], b[2], tier[b[3]]))
            if a[0] != b[0] and value > above:
                options.append((-value, b[0]))
        expected[a[0]] = [(i, -v) for v, i in sorted(options)[:n]]
    got = {}
    for row in sorted(D.similar_products(table, n, above).collect(), key=lambda x: (x.product_id, x.place)):
        got.setdefault(row.product_id, []).append((row.similar_id, row.similarity))
    assert got == {k: v for k, v in expected.items() if v}


def all_requests(shop, **options):
    values = {"top_k": 10, "candidate_pool": 100, "weight_preset": "balanced", "apply_diversity": True, **options}
    return shop["users"].select(
        F.col("user_id").alias("request_id"), "user_id", *[F.lit(v).alias(n) for n, v in values.items()]
    )


@pytest.mark.parametrize("preset", ["balanced", "lenskart", "clearance", "no such preset"])
def test_recommend(shop, shelf, preset):
    rows = R.recommend(all_requests(shop, weight_preset=preset), shop["users"], shelf).collect()
    assert {r.weights_used for r in rows} == {preset}
    by_user = {}
    for r in rows:
        by_user.setdefault(r.user_id, []).append(r)
    assert len(by_user) == 100
    for picks in by_user.values():
        assert sorted(p.rank for p in picks) == list(range(1, 11))
        assert len({p.product_id for p in picks}) == 10
        for p in picks:
            assert p.total_candidates == 50
            assert 0 <= p.propensity_score <= 1 and 0 <= p.final_score <= 1.5
            assert p.should_show_sale_badge == (p.urgency_label in ("High", "Critical"))
    unknown = R.recommend(all_requests(shop), shop["users"], shelf)
    if preset == "no such preset":
        pairs = lambda t: sorted((r.user_id, r.rank, r.product_id) for r in t)
        assert pairs(rows) == pairs(unknown.collect())


def test_recommend_equals_scoring_every_pair(shop, shelf):
    """Without diversity the result is the best of all products, scored one by one."""
    rates = {r.product_id: (r, r.segment_rates) for r in shelf.collect()}
    segments = {r.user_id: r.segment for r in shop["users"].collect()}
    w = next(p for p in fixed.PRESETS if p["name"] == "dyson")
    rows = R.recommend(
        all_requests(shop, weight_preset="dyson", apply_diversity=False, top_k=3), shop["users"], shelf
    ).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.rank):
        got.setdefault(r.user_id, []).append(r.product_id)
    for user, segment in segments.items():
        scores = []
        for product_id, (p, by_segment) in rates.items():
            propensity = (by_segment or {}).get(segment, 0.5)
            score = (
                w["propensity"] * propensity + w["inventory"] * p.inventory_pressure
                + w["margin"] * p.margin_score + w["trend"] * p.trend_score
                + w["demand_spike"] * p.demand_spike
            )
            scores.append((-round(score, 6), product_id))
        assert got[user] == [i for _, i in sorted(scores)[:3]]


def test_candidate_join_without_broadcast(monkeypatch, shop, shelf):
    small = R.recommend(all_requests(shop), shop["users"], shelf)
    monkeypatch.setattr("vitrine.operators.ranking.broadcast_if_small", lambda table: table)
    shop["users"].sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = R.recommend(all_requests(shop), shop["users"], shelf)
        key = lambda r: (r.user_id, r.rank, r.product_id, r.final_score)
        assert sorted(map(key, large.collect())) == sorted(map(key, small.collect()))
    finally:
        shop["users"].sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ranking_needs_one_shuffle_of_the_requests(shop, shelf):
    plan = R.recommend(all_requests(shop), shop["users"], shelf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("ArrowEvalPython") == 1
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_cold_start_for_unknown_users(spark, shop, shelf):
    requests = spark.createDataFrame(
        [("a", "u001", 5), ("b", "stranger", 5), ("c", "other", 3)], "request_id string, user_id string, top_k int"
    ).withColumns({"candidate_pool": F.lit(20), "weight_preset": F.lit("dyson"), "apply_diversity": F.lit(True)})
    rows = R.recommend_all(requests, shop["users"], shelf).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r.rank):
        found.setdefault(r.request_id, []).append(r)
    assert {k: len(v) for k, v in found.items()} == {"a": 5, "b": 5, "c": 3}
    assert found["a"][0].weights_used == "dyson" and found["a"][0].total_candidates == 20
    items = sorted(
        shelf.collect(),
        key=lambda p: (-(0.5 * p.trend_score + 0.3 * p.margin_score + 0.2 * p.avg_rating / 5), p.product_id),
    )
    assert [r.product_id for r in found["b"]] == [p.product_id for p in items[:5]]
    for r in found["c"]:
        assert r.weights_used == "cold_start" and r.propensity_score == 0.5
        assert r.optimal_discount_pct == 0.0 and r.total_candidates == 50


def test_cold_start_is_as_long_as_asked(spark, shelf):
    requests = spark.createDataFrame(
        [("a", "x", 45), ("b", "y", None), ("c", "z", 500)], "request_id string, user_id string, top_k int"
    )
    counts = {r.request_id: r["count"] for r in R.cold_start(requests, shelf).groupBy("request_id").count().collect()}
    assert counts == {"a": 45, "b": 20, "c": 50}


@pytest.mark.parametrize("pool, expected", [(None, 50), (0, 0), (9, 0), (10, 10), (500, 50), (10**6, 0)])
def test_pool_sizes(spark, shop, shelf, pool, expected):
    requests = spark.createDataFrame(
        [("a", "u001", 5, pool, "balanced", True)],
        "request_id string, user_id string, top_k int, candidate_pool int, weight_preset string, apply_diversity boolean",
    )
    rows = R.recommend(requests, shop["users"], shelf).collect()
    assert {r.total_candidates for r in rows} == ({expected} if expected else set())


def test_candidates_of_raw_pools(spark):
    requests = spark.createDataFrame([(1, "a", None), (2, "a", 0), (3, "a", 10**6)], "request_id int, user_id string, candidate_pool int")
    got = {r.request_id: r["count"] for r in sampling.with_candidates(requests, 1000).groupBy("request_id").count().collect()}
    assert got == {1: 100, 3: 1000}
    assert sampling.with_candidates(requests, 0).count() == 0


@pytest.mark.parametrize("diverse", [True, False])
def test_whole_catalogue_equals_ranking_every_product(shop, shelf, diverse):
    """A pool as large as the shop gives the same picks as the lists per segment."""
    asked = all_requests(shop, candidate_pool=50, apply_diversity=diverse, weight_preset="clearance", top_k=12)
    names = ["user_id", "rank", "product_id", "pick_score", "final_score", "weights_used", "total_candidates"]
    pick = lambda t: sorted(tuple(r[n] for n in names) for r in t.collect())
    assert pick(R.recommend_whole(asked, shop["users"], shelf)) == pick(R.recommend(asked, shop["users"], shelf))


def test_whole_catalogue_mixes_settings(shop, shelf):
    asked = all_requests(shop, top_k=7).withColumn("top_k", F.when(F.col("user_id") < "u050", 3).otherwise(F.col("top_k")))
    rows = R.recommend_whole(asked, shop["users"], shelf)
    counts = {r.user_id: r["count"] for r in rows.groupBy("user_id").count().collect()}
    assert all(n == (3 if user < "u050" else 7) for user, n in counts.items()) and len(counts) == 100
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert R.recommend_whole(asked.filter("false"), shop["users"], shelf).count() == 0


def test_every_request_is_answered(spark, shop, shelf):
    requests = spark.createDataFrame(
        [(1, "u001", 5, 20), (2, "stranger", 5, 20), (3, "u001", 0, 20), (4, None, 5, 20), (5, "u001", 5, 10**6)],
        "request_id int, user_id string, top_k int, candidate_pool int",
    ).withColumns({"weight_preset": F.lit("dyson"), "apply_diversity": F.lit(True)})
    rows = R.answer(requests, shop["users"], shelf).collect()
    assert {r.request_id: r.reject_reason for r in rows if r.reject_reason} == {3: "top_k", 4: "user_id", 5: "candidate_pool"}
    assert sorted(r.request_id for r in rows if not r.reject_reason) == [1] * 5 + [2] * 5


def test_score_pairs_and_errors(spark, shop, shelf):
    requests = spark.createDataFrame(
        [(1, "u001", "p001", "amazon"), (2, "nobody", "p001", "amazon"), (3, "u001", "nothing", "amazon")],
        "request_id int, user_id string, product_id string, weight_preset string",
    )
    rows = {r.request_id: r for r in R.score_pairs(requests, shop["users"], shelf).collect()}
    assert rows[1].error is None and 0 <= rows[1].final_score <= 1.5
    for bad in (2, 3):
        assert rows[bad].error == "User or product not found" and rows[bad].final_score is None


def test_request_limits(spark):
    rows = [(1, "u", 0, 100), (2, "u", 101, 100), (3, "u", 20, 9), (4, "u", 20, 501), (5, "u", None, None), (6, None, 1, 10)]
    table = spark.createDataFrame(rows, "request_id int, user_id string, top_k int, candidate_pool int").withColumns(
        {"weight_preset": F.lit(None).cast("string"), "apply_diversity": F.lit(None).cast("boolean")}
    )
    got = {r.request_id: r for r in U.validate_requests(table).collect()}
    assert [got[i].reject_reason for i in range(1, 7)] == ["top_k", "top_k", "candidate_pool", "candidate_pool", None, "user_id"]
    assert (got[5].top_k, got[5].candidate_pool, got[5].weight_preset, got[5].apply_diversity) == (20, 100, "balanced", True)


def test_nested_response_keeps_rank_order(shop, shelf):
    rows = R.nested_response(R.recommend(all_requests(shop), shop["users"], shelf)).collect()
    assert len(rows) == 100
    assert all([p.rank for p in r.products] == list(range(1, 11)) for r in rows)


def test_presets(spark):
    table = {r.name: r for r in X.validate_presets(X.presets(spark)).collect()}
    assert set(table) == {"balanced", "lenskart", "dyson", "amazon", "clearance"}
    assert all(r.is_valid and r.weight_sum == 1.0 for r in table.values())
    bad = X.presets(spark).withColumn("propensity", F.lit(0.9))
    assert not any(r.is_valid for r in X.validate_presets(bad).collect())


def test_ab_assignment_is_stable_and_spread(spark):
    users = spark.createDataFrame([(f"U{i:05d}",) for i in range(2000)], "user_id string")
    first = sorted(X.ab_assign(users).collect())
    assert first == sorted(X.ab_assign(users.repartition(7)).collect())
    counts = {r.variant: r.n_users for r in X.variant_distribution(X.ab_assign(users)).collect()}
    assert set(counts) == {"balanced", "lenskart", "dyson", "amazon"}
    assert 0.36 < counts["balanced"] / 2000 < 0.44
    assert first != sorted(X.ab_assign(users, "another").collect())


def test_storefront_flags(spark):
    rows = [(0.71, 9.0, 10.0, 0.5, 0.05), (0.70, 10.0, 10.0, 1.2, 0.0)]
    table = spark.createDataFrame(
        rows, "demand_spike double, current_price double, base_price double, final_score double, optimal_discount_pct double"
    )
    got = [tuple(r)[5:] for r in R.storefront_flags(table).collect()]
    assert sorted(got) == sorted([(True, True, 50.0, True), (False, False, 100.0, False)])


def test_stream_resumes_and_replaces(spark, shop, shelf, tmp_path):
    base = str(tmp_path)
    asked = all_requests(shop)
    asked.filter("user_id < 'u050'").write.mode("append").parquet(f"{base}/in")
    run = lambda: serving.serve(
        spark.readStream.schema(asked.schema).parquet(f"{base}/in"), shop["users"], shelf, f"{base}/out", f"{base}/progress"
    ).awaitTermination()
    run()
    assert spark.read.parquet(f"{base}/out").select("user_id").distinct().count() == 50
    asked.filter("user_id >= 'u050'").write.mode("append").parquet(f"{base}/in")
    run()
    answers = spark.read.parquet(f"{base}/out")
    assert answers.count() == 1000 and answers.select("batch").distinct().count() == 2
