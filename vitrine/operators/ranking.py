"""Scores for (user, product) pairs, ranked lists, cold start, sale badges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine import fixed
from vitrine.functions import scalars as S
from vitrine.operators import diversity as D
from vitrine.operators import experiments as X
from vitrine.operators.features import validate_requests
from vitrine.operators.inventory import with_labels
from vitrine.operators.ordering import dense_index
from vitrine.operators.propensity import closed_form_propensity
from vitrine.operators.sampling import with_blocks, with_candidates
from vitrine.operators.skew import keyed_join, lookup_join
from vitrine.sources.staging import broadcast_if_small, is_small, stage

# Catalogue columns that are shown, or that a learned scorer reads.

KEPT = ["category", "brand", *fixed.PRODUCT_TRAINING]


def product_scores(
    products: DataFrame,
    pressure: DataFrame | None,
    spikes: DataFrame,
    discounts: DataFrame | None = None,
    rates: DataFrame | None = None,
) -> DataFrame:
    """Everything ranking needs to know of a product, computed once for all users.

    What ``products`` already has of pressure and discount is taken as it is and needs no
    join.  Missing pressure and spike count as one half.  Each input holds a product once, but
    ``rates``, which is a model from ``fit_rates``.
    """
    half = F.lit(fixed.DEFAULT_SCORE)
    known = ["inventory_pressure", "optimal_discount_pct", "expected_uplift"]
    known = [name for name in known if name in products.columns]
    scored = products.select("product_id", "style_cluster", *KEPT, *known)
    if pressure is not None:
        scored = scored.join(pressure, "product_id", "left")
    scored = scored.join(spikes, "product_id", "left")
    scored = scored.withColumns(
        {
            "inventory_pressure": F.coalesce("inventory_pressure", half),
            "demand_spike": F.coalesce("demand_spike", half),
        }
    )
    if discounts is not None:
        scored = scored.join(
            discounts.select("product_id", "optimal_discount_pct", "expected_uplift"),
            "product_id",
            "left",
        )
    if rates is not None:
        scored = lookup_join(scored, rates, "category", "left")
    return scored


def positions(products: DataFrame) -> DataFrame:
    """Dense catalogue positions, from the product ids alone."""
    return dense_index(products.select("product_id"), "product_id", "product_index")


def catalogue(scored: DataFrame, numbered: DataFrame) -> DataFrame:
    """Product scores with their positions, staged for the jobs that rank with them."""
    return stage(scored.join(numbered, "product_id"), "catalogue")


def weighted_sum(propensity: Column, product: Column | None = None) -> Column:
    """Weighted sum of the five signals of a row that holds the preset's weights; what is known
    of the product is in the row too, or in a struct ``product``."""

    def signal(name: str) -> Column:
        return F.col(name) if product is None else product[name]

    return (
        F.col("propensity") * propensity
        + F.col("inventory") * signal("inventory_pressure")
        + F.col("margin") * signal("margin_score")
        + F.col("trend") * signal("trend_score")
        + F.col("demand_spike_weight") * signal("demand_spike")
    )


def weighted_score(propensity: Column) -> Column:
    return S.quick_rnd(weighted_sum(propensity), 6)


# What the default scorer and diversity read of a product.
SCORED = [
    "product_id", "product_index", "style_cluster", "category", "current_price", "inventory_pressure",
    "margin_score", "trend_score", "demand_spike", "segment_rates",
]


def candidate_pairs(
    requests: DataFrame,
    staged_catalogue: DataFrame,
    key: str,
    columns: list[str] | None = None,
    longest: int | None = None,
) -> DataFrame:
    """Each request with its sampled products, or the named ``columns`` of them.

    With a catalogue under the broadcast bound the requests are partitioned by ``key`` while
    they are still narrow.  The candidates are generated inside that partitioning and the
    catalogue joins without moving them, so later grouping by ``key`` needs no second shuffle.

    A larger catalogue is cut into blocks that each hold the whole pools of their requests
    (``sampling.with_blocks``), if no pool is over ``longest``: pairs are not shuffled, and
    grouping by ``group_of`` needs no shuffle either.  Without ``longest`` it joins by shuffle;
    positions are spread evenly, so no key is hot.
    """
    spark = requests.sparkSession
    n_products = staged_catalogue.count()
    shelf = staged_catalogue.select(*columns) if columns else staged_catalogue
    if longest and n_products and not is_small(staged_catalogue):
        met = with_blocks(requests, shelf, n_products, longest)
        pairs = met.withColumn("item", F.explode("items")).drop("items")
        return pairs.select("*", *[F.col("item")[name].alias(name) for name in shelf.columns]).drop("item")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = with_candidates(requests.repartition(partitions, key), n_products)
    return pairs.join(F.broadcast(shelf) if is_small(staged_catalogue) else shelf, "product_index")


def group_of(pairs: DataFrame, key: str) -> list[str]:
    """What to group (request, product) rows by: rows that lie by ``slot`` stay there."""
    return ["slot", key] if "slot" in pairs.columns else [key]


def split_known(requests: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests of users in the store, and of users who are not."""
    keys = users.select("user_id")
    known = keyed_join(requests, keys, "user_id", "left_semi")
    unknown = keyed_join(requests, keys, "user_id", "left_anti")
    return known, unknown


def rank_by_score(rows: DataFrame, group: str | list[str], score: str) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.desc(score), "product_id")
    return rows.withColumn("rank", F.row_number().over(order))


def top_k(rows: DataFrame, group: str | list[str], score: str, k: int) -> DataFrame:
    """Best k per group; Spark keeps at most k rows per group and task before the shuffle."""
    return rank_by_score(rows, group, score).filter(F.col("rank") <= k)


def score_breakdown(propensity: Column) -> Column:
    return F.struct(
        S.rnd(F.col("propensity") * propensity, 4).alias("propensity"),
        S.rnd(F.col("inventory") * F.col("inventory_pressure"), 4).alias("inventory"),
        S.rnd(F.col("margin") * F.col("margin_score"), 4).alias("margin"),
        S.rnd(F.col("trend") * F.col("trend_score"), 4).alias("trend"),
        S.rnd(F.col("demand_spike_weight") * F.col("demand_spike"), 4).alias("demand_spike"),
    )


def response_columns() -> list[Column]:
    four = ["propensity_score", "inventory_pressure", "margin_score", "trend_score", "demand_spike"]
    return [
        S.rnd(F.col("final_score"), 4).alias("final_score"),
        *[S.rnd(F.col(name), 4).alias(name) for name in four],
        F.col("should_show_sale_badge"),
        F.col("urgency_label"),
        F.coalesce("optimal_discount_pct", F.lit(0.0)).alias("optimal_discount_pct"),
        F.col("category"),
        F.col("brand"),
        S.rnd(F.col("current_price"), 2).alias("current_price"),
        S.rnd(F.col("base_price"), 2).alias("base_price"),
        F.col("avg_rating"),
    ]


def rated(pairs: DataFrame) -> DataFrame:
    """Default scorer: the segment's purchase rate in the product's category."""
    rate = closed_form_propensity(F.col("segment"), F.col("segment_rates"))
    return pairs.withColumn("propensity_score", rate)


def recommend(
    requests: DataFrame,
    users: DataFrame,
    staged_catalogue: DataFrame,
    scorer=rated,
    key: str = "request_id",
) -> DataFrame:
    """Ranked products for every request of a known user.

    ``requests`` has ``key``, user_id, top_k, candidate_pool, weight_preset and
    apply_diversity; ``scorer`` adds ``propensity_score`` to (request, product) rows.
    Requests outside the limits get no products, so no pool is larger than they allow.
    """
    wanted = accepted(requests, key)
    if scorer is rated:
        users = users.select("user_id", "segment")
    asked = X.join_presets(
        keyed_join(wanted, users, "user_id", unique=key), "weight_preset"
    )
    if scorer is rated and not is_small(staged_catalogue):
        return picked(rated_lists(asked, staged_catalogue), staged_catalogue, key)
    pairs = with_scores(
        scorer(candidate_pairs(asked, staged_catalogue, key, longest=fixed.CANDIDATE_POOL[2]))
    )
    # Most candidates can no longer be picked: they are left out before a request's are put
    # into one row.  The rows are partitioned by request already.
    group = group_of(pairs, key)
    pairs = D.prune(pairs, group, F.col("top_k"), F.col("diversity"), F.col("apply_diversity"))
    grouped = pairs.groupBy(*group).agg(
        *[F.first(name).alias(name) for name in PER_REQUEST],
        F.first("pool_size").alias("total_candidates"),
        D.sorted_candidates(F.col("score"), ["propensity_score"]).alias("candidates"),
    )
    return picked(grouped, staged_catalogue, key)


def rated_lists(asked: DataFrame, staged_catalogue: DataFrame) -> DataFrame:
    """Requests with the ``candidates`` that can be picked, under the default scorer and from a
    catalogue that is too large to broadcast.

    The products of a request come as one array, are scored and pruned in it and never become
    rows, so there is nothing to shuffle or to sort.
    """
    shelf = staged_catalogue.select(
        "product_id", "product_index", F.col("style_cluster").alias("cluster"), "category",
        S.price_tier(F.col("current_price")).alias("tier"), "inventory_pressure", "margin_score",
        "trend_score", "demand_spike", "segment_rates",
    )
    met = with_blocks(asked, shelf, staged_catalogue.count(), fixed.CANDIDATE_POOL[2])

    traits = ["product_id", "cluster", "category", "tier"]

    def weighed(item: Column) -> Column:
        rate = closed_form_propensity(F.col("segment"), item["segment_rates"])
        carried = [item[name].alias(name) for name in traits]
        return F.struct(weighted_sum(rate, item).alias("sum"), *carried, rate.alias("propensity_score"))

    def candidate(one: Column) -> Column:
        carried = [one[name].alias(name) for name in [*traits, "propensity_score"]]
        return F.struct((-S.quick_rnd(one["sum"], 6)).alias("neg_score"), *carried)

    scored = F.sort_array(F.transform(F.transform("items", weighed), candidate))
    # The items are named twice, or Spark would cut them out of their block only after it has
    # copied the whole block for the request.
    listed = met.withColumns(
        {"candidates": scored, "total_candidates": F.size("items").cast("bigint")}
    ).drop("items")
    return listed.withColumn(
        "candidates",
        D.prune_sorted(F.col("candidates"), F.col("top_k"), F.col("diversity"), F.col("apply_diversity")),
    )


PER_REQUEST = [
    "user_id", "top_k", "apply_diversity", "weight_preset", "diversity",
]


def with_scores(pairs: DataFrame) -> DataFrame:
    """The score of each (request, product) row, and what diversity needs of the product."""
    return pairs.withColumns(
        {
            "score": weighted_score(F.col("propensity_score")),
            "cluster": F.col("style_cluster"),
            "tier": S.price_tier(F.col("current_price")),
        }
    )


def picked(grouped: DataFrame, staged_catalogue: DataFrame, key: str) -> DataFrame:
    """The ranked products of requests with their ``candidates``, described."""
    narrow = grouped.select(key, *PER_REQUEST, "total_candidates", "candidates")
    picks = D.mmr_picks(narrow, F.col("top_k"), F.col("diversity"), F.col("apply_diversity"))
    # The weights are in the preset's name, so that they need not travel with each pick.
    ranked = picks.select(
        key, "user_id", "weight_preset", "total_candidates", "rank", "product_id", "pick_score", "final_score",
        F.col("candidate.propensity_score").alias("propensity_score"),
    )
    described = staged_catalogue.drop("product_index", "style_cluster", "segment_rates")
    # The picks of many requests are spread over the catalogue, so no product is hot here.
    full = with_labels(ranked.join(broadcast_if_small(described), "product_id"))
    return X.join_presets(full, "weight_preset").select(
        key,
        "user_id",
        "rank",
        "product_id",
        S.rnd(F.col("pick_score"), 6).alias("pick_score"),
        *response_columns(),
        score_breakdown(F.col("propensity_score")).alias("score_breakdown"),
        F.col("weight_preset").alias("weights_used"),
        "total_candidates",
    )


def cold_start_list(scored: DataFrame, k: int) -> DataFrame:
    """The k best products for a stranger: trending, high margin, well rated."""
    score = (
        0.5 * F.col("trend_score") + 0.3 * F.col("margin_score") + 0.2 * F.col("avg_rating") / 5.0
    )
    return (
        scored.withColumn("score", score)
        .orderBy(F.desc("score"), "product_id")
        .limit(k)
        .select("*", F.row_number().over(Window.orderBy(F.desc("score"), "product_id")).alias("rank"))
    )


def cold_start(requests: DataFrame, scored: DataFrame, k: int | None = None) -> DataFrame:
    """The same list for every request, cut to its top_k, or to the default without one.

    The list is as long as the longest request, or ``k``.
    """
    wanted = F.coalesce("top_k", F.lit(fixed.TOP_K[0]))
    longest = k or requests.agg(F.max(wanted)).first()[0] or 0
    item = with_labels(cold_start_list(scored, longest)).select(
        F.col("rank"),
        F.col("product_id"),
        F.col("score").alias("pick_score"),
        F.col("score").alias("final_score"),
        F.lit(fixed.DEFAULT_SCORE).alias("propensity_score"),
        "inventory_pressure",
        "margin_score",
        "trend_score",
        "demand_spike",
        "should_show_sale_badge",
        "urgency_label",
        F.lit(0.0).alias("optimal_discount_pct"),
        "category",
        "brand",
        "current_price",
        "base_price",
        "avg_rating",
    )
    names = item.columns
    items = item.agg(F.sort_array(F.collect_list(F.struct(*names)))).scalar()
    total = scored.agg(F.count(F.lit(1))).scalar()
    listed = requests.withColumn("item", F.explode(F.slice(items, 1, wanted)))
    empty = F.struct(*[F.lit(None).cast("double").alias(signal) for signal in fixed.SIGNALS])
    flat = listed.select(
        "request_id", "user_id", *[F.col("item")[name].alias(name) for name in names]
    )
    return flat.select(
        "request_id",
        "user_id",
        "rank",
        "product_id",
        S.rnd(F.col("pick_score"), 6).alias("pick_score"),
        *response_columns(),
        empty.alias("score_breakdown"),
        F.lit("cold_start").alias("weights_used"),
        total.alias("total_candidates"),
    )


def accepted(requests: DataFrame, key: str) -> DataFrame:
    """Requests within the limits, with the defaults filled in."""
    names = [key, "user_id", "top_k", "candidate_pool", "weight_preset", "apply_diversity"]
    valid = validate_requests(requests.select(*dict.fromkeys(names)))
    return valid.filter("reject_reason is null").drop("reject_reason")


LIST = ["segment", "preset", "top_k", "apply_diversity"]


def whole_lists(asked: DataFrame, staged_catalogue: DataFrame) -> DataFrame:
    """The list for each segment, preset, top_k and diversity setting that is asked for, from
    the whole catalogue.

    Under the default scorer a score depends on segment, preset and product only.  Products
    of equal cluster, category and price tier carry equal penalties, so of each such cell
    only its best k can be picked: a window group limit cuts the cells down before the
    shuffle, and the picks run on what is left.
    """
    signals = [*fixed.SIGNALS[:-1], "demand_spike_weight", "diversity"]
    lists = stage(asked.select(*LIST, *signals).distinct(), "lists")
    kinds = ["segment", "preset", *signals[:-1]]
    # A struct for each segment and preset that is in use.
    used = lists.select(*kinds).distinct()
    combinations = used.agg(F.collect_list(F.struct(*kinds))).scalar()
    most = lists.agg(F.max("top_k")).first()[0] or 0
    scored = rated(
        staged_catalogue.withColumn("kind", F.explode(combinations)).select("*", "kind.*")
    ).withColumns(
        {
            "score": weighted_score(F.col("propensity_score")),
            "cluster": F.col("style_cluster"),
            "tier": S.price_tier(F.col("current_price")),
        }
    )
    cell = Window.partitionBy("segment", "preset", "cluster", "category", "tier").orderBy(
        F.desc("score"), "product_id"
    )
    pools = (
        scored.withColumn("place", F.row_number().over(cell))
        .filter(F.col("place") <= most)
        .groupBy(F.col("segment").alias("segment_"), F.col("preset").alias("preset_"))
        .agg(D.sorted_candidates(F.col("score"), ["propensity_score"]).alias("candidates"))
    )
    same = F.col("segment").eqNullSafe(F.col("segment_")) & (F.col("preset") == F.col("preset_"))
    picks = D.mmr_picks(
        lists.join(pools, same), F.col("top_k"), F.col("diversity"), F.col("apply_diversity")
    )
    return picks.select(
        *LIST, "rank", "product_id", "pick_score", "final_score",
        F.col("candidate.propensity_score").alias("propensity_score"),
    )


def recommend_whole(
    requests: DataFrame, users: DataFrame, staged_catalogue: DataFrame, key: str = "request_id"
) -> DataFrame:
    """Ranked products of the whole catalogue for every request of a known user, under the
    default scorer.

    Lists are worked out per segment and setting and joined to the requests, so no pairs of
    users and products are formed.
    """
    known = keyed_join(
        accepted(requests, key), users.select("user_id", "segment"), "user_id", unique=key
    )
    asked = X.join_presets(known, "weight_preset")
    picks = whole_lists(asked, staged_catalogue)
    described = staged_catalogue.drop("product_index", "style_cluster", "segment_rates")
    full = with_labels(picks.join(broadcast_if_small(described), "product_id"))
    weights = X.join_presets(
        full.drop("demand_spike_weight").withColumnRenamed("preset", "list_preset"), "list_preset"
    ).withColumn("preset", F.col("list_preset"))
    list_key = F.to_json(F.struct(*LIST))
    shown = stage(
        weights.select(
            list_key.alias("list_key"),
            "rank",
            "product_id",
            S.rnd(F.col("pick_score"), 6).alias("pick_score"),
            *response_columns(),
            score_breakdown(F.col("propensity_score")).alias("score_breakdown"),
        ),
        "whole_lists",
    )
    total = staged_catalogue.agg(F.count(F.lit(1))).scalar()
    rows = asked.select(key, "user_id", "weight_preset", list_key.alias("list_key"))
    listed = lookup_join(rows, shown, "list_key").drop("list_key")
    names = [name for name in listed.columns if name not in (key, "user_id", "weight_preset")]
    return listed.select(
        key, "user_id", *names, F.col("weight_preset").alias("weights_used"),
        total.alias("total_candidates"),
    )


def answer(
    requests: DataFrame, users: DataFrame, staged_catalogue: DataFrame, scorer=rated
) -> DataFrame:
    """Every request answered: ranked products for known users, the cold start list for
    unknown ones, and one row with the ``reject_reason`` for requests outside the limits."""
    checked = validate_requests(requests)
    valid = checked.filter("reject_reason is null").drop("reject_reason")
    ranked = recommend_all(valid, users, staged_catalogue, scorer)
    rejected = checked.filter("reject_reason is not null").select(
        "request_id", "user_id", "reject_reason"
    )
    return ranked.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(
        rejected, allowMissingColumns=True
    )


def recommend_all(
    requests: DataFrame, users: DataFrame, staged_catalogue: DataFrame, scorer=rated
) -> DataFrame:
    """Ranked products for every request: personal for known users, cold start for the rest.

    Requests outside the limits get neither, so the cold start list is as long as they allow.
    """
    _, unknown = split_known(accepted(requests, "request_id"), users)
    return recommend(requests, users, staged_catalogue, scorer).unionByName(
        cold_start(unknown, staged_catalogue)
    )


def score_pairs(
    requests: DataFrame, users: DataFrame, scored: DataFrame, scorer=rated
) -> DataFrame:
    """Score of each requested (user, product); ``error`` is set when either is unknown."""
    # A product may be in a third of the requests, so both joins guard against hot keys.
    store = users.withColumn("user_found", F.lit(True))
    shelf = scored.drop("product_index").withColumn("product_found", F.lit(True))
    rows = keyed_join(requests, store, "user_id", "left")
    rows = keyed_join(rows, shelf, "product_id", "left", sketch=requests)
    rows = with_labels(scorer(X.join_presets(rows, "weight_preset")))
    found = F.col("user_found") & F.col("product_found")
    known = F.coalesce(found, F.lit(False))
    columns = {
        "final_score": S.rnd(weighted_sum(F.col("propensity_score")), 4),
        **{
            name: S.rnd(F.col(name), 4)
            for name in (
                "propensity_score", "inventory_pressure", "margin_score", "trend_score",
                "demand_spike",
            )
        },
        "should_show_sale_badge": F.col("should_show_sale_badge"),
        "urgency_label": F.col("urgency_label"),
        "optimal_discount_pct": F.coalesce("optimal_discount_pct", F.lit(0.0)),
        "expected_uplift": F.coalesce("expected_uplift", F.lit(0.0)),
    }
    return rows.select(
        "request_id",
        "user_id",
        "product_id",
        *[F.when(known, column).alias(name) for name, column in columns.items()],
        F.col("weight_preset").alias("weights_used"),
        F.when(~known, fixed.NOT_FOUND_TEXT).alias("error"),
    )


def sale_badges(scored: DataFrame) -> DataFrame:
    """Badge, urgency and best discount of every product."""
    return with_labels(scored).select(
        "product_id",
        "should_show_sale_badge",
        S.rnd(F.col("inventory_pressure"), 4).alias("inventory_pressure_score"),
        "urgency_label",
        F.coalesce("optimal_discount_pct", F.lit(0.0)).alias("optimal_discount_pct"),
        F.coalesce("expected_uplift", F.lit(0.0)).alias("expected_uplift"),
    )


def badge_counts(ranked: DataFrame, key: str = "user_id") -> DataFrame:
    return ranked.groupBy(key).agg(
        F.count_if("should_show_sale_badge").alias("n_badges"),
        F.count(F.lit(1)).alias("n_products"),
    )


def storefront_flags(ranked: DataFrame) -> DataFrame:
    """What the shop page shows on a ranked product."""
    return ranked.withColumns(
        {
            "show_trending": F.col("demand_spike") > fixed.TRENDING_ABOVE,
            "show_markdown": F.col("current_price") < F.col("base_price"),
            "score_bar": S.rnd(F.least(F.col("final_score") * 100, F.lit(100.0)), 4),
            "show_discount": F.col("optimal_discount_pct") > 0,
        }
    )


def nested_response(ranked: DataFrame, key: str = "request_id") -> DataFrame:
    """One row per request with its products as an array, in rank order."""
    outer = {key, "user_id", "weights_used", "total_candidates"}
    inner = ["rank", *[name for name in ranked.columns if name not in outer and name != "rank"]]
    return ranked.groupBy(key).agg(
        F.first("user_id").alias("user_id"),
        F.sort_array(F.collect_list(F.struct(*inner))).alias("products"),
        F.first("weights_used").alias("weights_used"),
        F.first("total_candidates").alias("total_candidates"),
    )
