"""Demand, elasticity, inventory, propensity and the tree models."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests import small
from vitrine import fixed
from vitrine.functions import vectors as V
from vitrine.operators import demand as D
from vitrine.operators import elasticity as E
from vitrine.operators import features as U
from vitrine.operators import inventory as I
from vitrine.operators import learners as L
from vitrine.operators import propensity as P
from vitrine.operators import ranking as R
from vitrine.operators import sampling

CODES = fixed.CATEGORY_CODES
TREES = 5


def daily_table(spark, counts):
    """(product, day offset, count) rows as a daily table."""
    rows = [(p, dt.date(2024, 1, 1) + dt.timedelta(days=d), n) for p, d, n in counts]
    return spark.createDataFrame(rows, "product_id string, sale_day date, daily_demand bigint")


def test_25_sale_days_give_five_training_rows(spark):
    daily = daily_table(spark, [("p000", d, 1) for d in range(25)])
    rows = D.training_days(daily).orderBy("day_no").collect()
    assert [r.day_no for r in rows] == [15, 16, 17, 18, 19]
    assert all(r.demand_7d == 7 and r.demand_14d == 14 and r.target_demand_7d == 7 for r in rows)


def test_windows_count_sale_days(spark):
    r = random.Random(1)
    days = sorted(r.sample(range(400), 60))
    counts = [r.randint(1, 9) for _ in days]
    daily = daily_table(spark, [("P", d, n) for d, n in zip(days, counts)])
    for row in D.rolling_demand(daily).collect():
        i = row.day_no - 1
        assert row.demand_7d == sum(counts[max(0, i - 7):i])
        assert row.demand_30d == sum(counts[max(0, i - 30):i])
        assert row.previous_7d == sum(counts[max(0, i - 14):max(0, i - 7)])
        assert row.target_demand_7d == (sum(counts[i:i + 7]) if i + 7 <= 60 else None)


def test_latest_features(spark, shop):
    counts = [("p001", d, d + 1) for d in range(20)] + [("p002", d, 2) for d in range(5)]
    latest = D.latest_features(
        daily_table(spark, counts), shop["products"], CODES, as_of=F.lit("2024-02-03").cast("date")
    )
    rows = {r.product_id: r for r in latest.collect()}
    one, two, none = rows["p001"], rows["p002"], rows["p003"]
    assert one.demand_7d == sum(range(14, 21)) and one.demand_30d == sum(range(1, 21))
    assert one.velocity == pytest.approx((119 - 70) / 70, abs=1e-6)
    assert (one.day_of_week, one.month, one.is_weekend) == (5, 2, 1)
    # Fewer than 14 sale days: the week before counts as equal.
    assert two.demand_7d == 10 and two.velocity == 0
    assert all(none[name] == 0 for name in fixed.DEMAND_COLUMNS)


def test_training_set_imputes_missing_products(spark, shop):
    daily = daily_table(spark, [("gone", d, 1) for d in range(25)])
    row = D.training_set(daily, shop["products"], CODES).first()
    assert (row.trend_score, row.avg_rating, row.seasonal_relevance, row.base_price) == (0.5, 3.5, 0.5, 50.0)
    assert (row.is_new_launch, row.category_encoded) == (0, 0)


def test_spike_falls_back_to_trend_with_few_samples(spark, shop):
    daily = daily_table(spark, [("p001", d, 1) for d in range(25)])
    latest = D.latest_features(daily, shop["products"], CODES)
    predicted, baseline = D.predict_closed_form(latest), D.demand_baseline(daily)
    spikes = D.demand_spikes(predicted, baseline, shop["products"], fallback=True)
    trends = {r.product_id: r.trend_score for r in shop["products"].collect()}
    assert {r.product_id: r.demand_spike for r in spikes.collect()} == trends
    # Without a model there is nothing to fall back from: the closed form needs no samples.
    plain = {r.product_id: r.demand_spike for r in D.demand_spikes(predicted, baseline, shop["products"]).collect()}
    assert plain != trends and all(0 <= v <= 1 for v in plain.values())
    model, metrics = L.train_demand(D.training_set(daily, shop["products"], CODES))
    assert model is None and tuple(metrics.first()) == (0.0, 0.0, 0)


def test_spike_values(spark):
    rows = spark.createDataFrame([(10.0, 20.0), (10.0, None), (1.0, 0.0), (40.0, 2.0)], "p double, b double")
    got = [r[0] for r in rows.select(D.spike_score(F.col("p"), F.col("b"))).collect()]
    assert got == [0.3333, 1.0, 0.6667, 1.0]


def test_spikes_from_one_order_of_the_days(spark, shop):
    r = random.Random(4)
    counts = [
        (f"p{p:03d}", d, r.randint(1, 9)) for p in range(40) for d in r.sample(range(90), p + 1)
    ] + [("gone", 3, 1)]
    daily = daily_table(spark, counts)
    latest = D.latest_features(daily, shop["products"], CODES)
    apart = D.demand_spikes(D.predict_closed_form(latest), D.demand_baseline(daily), shop["products"])
    at_once = D.closed_form_spikes(daily, shop["products"])
    # Windows over the days: one order of them, where there were two.
    orders = [t._jdf.queryExecution().optimizedPlan().toString().count("Window [") for t in (at_once, apart)]
    assert orders[0] == 1 < orders[1]
    assert sorted(at_once.collect()) == sorted(apart.collect())


def test_uplift_and_best_discount(shop):
    lines = E.fit_lines(shop["experiments"], shop["products"])
    grid = E.predict_uplift(shop["products"], lines)
    assert grid.count() == 50 * 11
    assert grid.filter("uplift < 0").count() == 0
    from_grid = sorted(E.best_of_grid(grid).collect())
    assert sorted(E.optimal_discounts(shop["products"], lines).collect()) == from_grid
    assert all(0 <= r.optimal_discount_pct <= 0.5 for r in from_grid)
    assert all(r.expected_margin_loss == round(r.optimal_discount_pct * 0.5, 4) for r in from_grid)


def test_best_discount_interior_and_ties(spark):
    rows = [("a", d / 100, u, 10.0, 5.0) for d, u in [(0, 0.0), (5, 0.2), (10, 0.21), (15, 0.2)]]
    rows += [("b", d / 100, 0.0, 10.0, 10.0) for d in (10, 0, 5)]
    grid = spark.createDataFrame(rows, "product_id string, discount double, uplift double, current_price double, cost_price double")
    got = {r.product_id: r for r in E.best_of_grid(grid).collect()}
    assert got["a"].optimal_discount_pct == 0.05 and got["a"].true_margin_loss == 0.025
    assert got["b"].optimal_discount_pct == 0.0


def test_experiments_of_unknown_products_are_skipped(spark, shop):
    extra = spark.createDataFrame([("gone", 0.1, 0.2)], "product_id string, discount_pct double, conversion_rate double")
    rows = E.experiment_features(shop["experiments"].unionByName(extra), shop["products"], CODES)
    assert rows.count() == 500


def test_inventory_pressure(shop):
    scores = [r.inventory_pressure for r in I.inventory_pressure(shop["products"], CODES).collect()]
    assert len(scores) == 50 and all(0 <= s <= 1 for s in scores) and len(set(scores)) > 40


def test_inventory_features_fill_nulls(spark):
    blank = small.PRODUCT_SCHEMA
    row = spark.createDataFrame([("P", "Home") + (None,) * 14], blank).withColumns(
        {"sell_through_rate": F.lit(None).cast("double"), "margin_score": F.lit(None).cast("double")}
    )
    got = I.inventory_features(row, CODES).first()
    assert [got[name] for name in fixed.INVENTORY_COLUMNS] == [0, 0, 0, 0, 0, 0, 0, 0, 2, 0]


def test_user_features_defaults(spark, shop):
    events = shop["events"].filter("user_id <> 'u007'")
    rows = {r.user_id: r for r in U.user_features(shop["users"], events).collect()}
    assert rows["u007"].purchase_count_30d == 0
    assert rows["u007"].avg_price_paid == rows["u007"].avg_order_value
    event_rows = [e for e in small.event_rows() if e[4] == "purchase" and e[1] == "u003"]
    assert rows["u003"].avg_price_paid == pytest.approx(sum(e[5] for e in event_rows) / len(event_rows))
    newest = max(e[3] for e in small.event_rows() if e[1] != "u007")
    assert rows["u003"].purchase_count_30d == sum(e[3] >= newest - dt.timedelta(days=30) for e in event_rows)


def test_vectors(shop):
    features = U.user_features(shop["users"], shop["events"])
    assert len(features.select(V.user_vector(features).alias("v")).first().v) == 17
    assert len(shop["products"].select(V.product_vector().alias("v")).first().v) == 14
    assert len(V.propensity_columns(shop["users"], CODES)) == 27


def test_training_union_balance(spark, shop):
    rows = sampling.training_union(shop["events"], 1)
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    assert counts[0] == counts[1]
    kinds = {r.event_type for r in rows.select("event_type").distinct().collect()}
    assert kinds <= {"purchase", "view", "wishlist"}


def test_purchase_rates(shop):
    """All negatives fit under three per purchase here, so the counts are plain counts."""
    segments = {r.user_id: r.segment for r in shop["users"].collect()}
    categories = {r.product_id: r.category for r in shop["products"].collect()}
    expected = {}
    for e in small.event_rows():
        if e[4] in ("purchase", "view", "wishlist"):
            n = expected.setdefault((segments[e[1]], categories[e[2]]), [0, 0])
            n[0] += 1
            n[1] += e[4] == "purchase"
    rows = P.purchase_rates(shop["events"], shop["users"], shop["products"]).collect()
    assert {(r.segment, r.category): (r.n_samples, r.n_purchases) for r in rows} == {
        k: tuple(v) for k, v in expected.items()
    }


def test_split_does_not_depend_on_partitions(spark):
    table = spark.range(1000)
    one = sorted(sampling.train_split(table.coalesce(1), F.col("id")).collect())
    assert one == sorted(sampling.train_split(table.repartition(9), F.col("id")).collect())
    assert 730 < sum(r.split == "train" for r in one) < 870


def test_propensity_trees(shop, shelf):
    pairs = P.training_pairs(shop["events"], shop["users"], shop["products"], CODES)
    columns = list(V.propensity_columns(shop["users"], CODES))
    model, metrics = L.train_propensity(pairs, columns, trees=TREES)
    row = metrics.first()
    assert 0 <= row.val_auc <= 1 and row.n_train + row.n_val == pairs.count()
    requests = shop["users"].select(F.col("user_id").alias("request_id"), "user_id").withColumns(
        {"top_k": F.lit(5), "candidate_pool": F.lit(20), "weight_preset": F.lit("amazon"), "apply_diversity": F.lit(True)}
    )
    scorer = L.propensity_scorer(model, shop["users"], CODES)
    ranked = R.recommend(requests, shop["users"], shelf, scorer).collect()
    assert len(ranked) == 500 and all(0 <= r.propensity_score <= 1 for r in ranked)
    assert len({r.propensity_score for r in ranked}) > 5


def test_elasticity_trees(shop):
    control, treated, metrics = L.train_elasticity(shop["experiments"], shop["products"], CODES, trees=TREES)
    row = metrics.first()
    assert 0 <= row.mse_control < 0.1 and 0 <= row.mse_treated < 1
    best = E.best_of_grid(L.grid_uplift(shop["products"], control, treated, CODES)).collect()
    assert len(best) == 50
    assert all(r.expected_uplift >= 0 and 0 <= r.optimal_discount_pct <= 0.5 for r in best)


def test_inventory_trees_save_and_load(shop, tmp_path):
    model, metrics = L.train_inventory(shop["products"], CODES, trees=TREES)
    assert metrics.first().val_mse < 0.1
    L.save(model, str(tmp_path / "model"))
    before = sorted(L.model_pressure(shop["products"], model, CODES).collect())
    assert sorted(L.model_pressure(shop["products"], L.load(str(tmp_path / "model")), CODES).collect()) == before
    assert all(0 <= r.inventory_pressure <= 1 for r in before)


def test_demand_trees(shop):
    daily = D.daily_demand(shop["events"].withColumn("event_type", F.lit("purchase")))
    rows = D.training_set(daily, shop["products"], CODES)
    model, metrics = L.train_demand(rows, trees=TREES)
    assert metrics.first().mae >= 0
    latest = D.latest_features(daily, shop["products"], CODES)
    spikes = D.demand_spikes(L.model_demand(latest, model), D.demand_baseline(daily), shop["products"])
    assert all(0 <= r.demand_spike <= 1 for r in spikes.collect())


def test_standard_scale(spark):
    table = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    rows = L.scaled_columns(table, ["a", "b"], table).orderBy("a").collect()
    assert [r.a for r in rows] == pytest.approx([-1.2247448, 0, 1.2247448])
    assert [r.b for r in rows] == [0, 0, 0]


def test_training_rows_are_dealt_to_all_cores(spark):
    """Their files are far under 4 MB, which made one task of them."""
    rows = spark.range(200_000).select("id", (F.col("id") % 7).cast("double").alias("x"))
    train, _ = L.held_out(rows, F.col("id"), "dealt")
    tasks = L.dealt(train).rdd.glom().map(len).collect()
    assert len(tasks) == 8 and min(tasks) > 0.9 * max(tasks)
    assert L.dealt(train.limit(100)).rdd.getNumPartitions() == 1


def test_equal_inputs_train_as_one_row_with_their_number(spark, shop):
    """Experiments of one product at one discount count by their mean and number."""
    columns = "product_id string, discount_pct double, conversion_rate double"
    rows = [(f"p{i % 50:03d}", (i % 11) / 100, (i % 13) / 20) for i in range(6000)]
    train, _ = L.held_out(
        E.experiment_features(spark.createDataFrame(rows, columns), shop["products"], CODES),
        F.concat_ws(":", "product_id", "discount_pct", "conversion_rate"), "repeats",
    )
    mean = F.avg("conversion_rate").alias("conversion_rate")
    inputs = L.repeated(train, L.ELASTICITY_INPUT, mean, name="repeats_inputs")
    total = inputs.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("conversion_rate"))).first()
    plain = train.agg(F.count(F.lit(1)), F.sum("conversion_rate")).first()
    assert total[0] == plain[0] and total[1] == pytest.approx(plain[1])
    assert inputs.count() <= 550 < plain[0]
