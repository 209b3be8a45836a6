"""Reference SQL for the registered queries, written for DuckDB over the same tables.

Shared steps are named CTEs; ``sql`` puts the ones a query uses in front of it.
"""

from __future__ import annotations

import re

from vitrine import fixed
from vitrine.operators.experiments import WEIGHTS
from vitrine.operators.sampling import STRIDES
from vitrine.sources.tables import REQUEST_PRESETS, SEGMENT_OF, WEB_EVENT_TYPES

KINDS = list(fixed.PART_TYPE_CODES)


def rnd(value: str, places: int) -> str:
    return f"round(({value})::double::varchar::decimal(30, 12), {places})::double"


def case(value: str, names: dict, other: str) -> str:
    def text(v):
        return f"'{v}'" if isinstance(v, str) else str(v)

    arms = " ".join(f"when {text(k)} then {text(v)}" for k, v in names.items())
    return f"case {value} {arms} else {other} end"


def segment_code(value: str) -> str:
    return case(value, fixed.SEGMENT_CODES, "0") + "::int"


def category_code(value: str) -> str:
    return case(value, fixed.PART_TYPE_CODES, "0") + "::int"


def hash_number(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::bigint"


def tier(price: str) -> str:
    b = fixed.PRICE_TIER_BOUNDS
    return (
        f"(case when {price} < {b[0]} then 4 when {price} < {b[1]} then 0 when {price} < {b[2]} "
        f"then 1 when {price} < {b[3]} then 2 when {price} < {b[4]} then 3 else 4 end)::int"
    )


def urgency(score: str) -> str:
    return (
        f"case when {score} >= 0.85::double then 'Critical' when {score} >= 0.65::double then 'High' "
        f"when {score} >= 0.35::double then 'Medium' else 'Low' end"
    )


def similarity(a: str, b: str) -> str:
    return rnd(
        f"0.5::double * ({a}.cluster = {b}.cluster)::int + 0.3::double * ({a}.category = {b}.category)::int"
        f" + 0.2::double * (1 - abs({a}.tier - {b}.tier) / 5.0::double)",
        4,
    )


def velocity(now: str, before: str) -> str:
    return f"(({now}) - ({before})) / (({before}) + 1e-6::double)"


AFFINITIES = [f"affinity_{kind.lower()}" for kind in KINDS]

CTES: dict[str, str] = {
    "order_history": """
        select o_custkey as user_id, max(o_orderdate) as last_order, min(o_orderdate) as first_order,
               count(*) filter (where o_orderdate >= (select max(o_orderdate) from orders) - interval 90 day) as orders_90d,
               avg(o_totalprice) as avg_order_value, sum(o_totalprice) as lifetime_spend
        from orders group by 1""",
    "user_lines": """
        select o_custkey as user_id, p_type, (l_discount >= 0.05::double)::int as discounted
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey""",
    "user_kinds": "select user_id, p_type, count(*) as n from user_lines group by 1, 2",
    "user_favourite": """
        select user_id, p_type as preferred from user_kinds
        qualify row_number() over (partition by user_id order by n desc, p_type) = 1""",
    "user_tastes": "select user_id, count(*) as n_lines, sum(discounted) as n_discounted, "
    + ", ".join(f"count(*) filter (where p_type = '{k}') as n_{k.lower()}" for k in KINDS)
    + " from user_lines group by 1",
    "user_web": """
        select user_id,
               count(distinct case when ts >= (select max(ts) from events) - interval 7 day then ts::date end) as sessions,
               count(*) filter (where event_type = 'purchase') as bought,
               count(*) filter (where event_type = 'click') as clicked
        from events group by 1""",
    "users": f"""
        select c_custkey as user_id,
               coalesce(date_diff('day', last_order::date, (select max(o_orderdate) from orders)::date), 0)::int as recency_days,
               coalesce(orders_90d, 0)::bigint as purchase_freq_90d,
               coalesce(avg_order_value, 0)::double as avg_order_value,
               coalesce(lifetime_spend, 0)::double as lifetime_spend,
               coalesce(date_diff('day', first_order::date, (select max(o_orderdate) from orders)::date), 0)::int as account_age_days,
               coalesce(n_discounted, 0)::double / greatest(coalesce(n_lines, 0), 1) as price_sensitivity,
               coalesce(sessions, 0)::bigint as sessions_7d,
               coalesce(1 - bought::double / greatest(clicked + bought, 1), 0)::double as cart_abandon_rate,
               {case("c_mktsegment", SEGMENT_OF, "'New'")} as segment,
               coalesce(preferred, '') as preferred_category,
               {", ".join(
                   f"case when preferred = '{k}' then least(1.0::double, coalesce(n_{k.lower()}, 0)::double / greatest(coalesce(n_lines, 0), 1) + 0.4::double) "
                   f"else coalesce(n_{k.lower()}, 0)::double / greatest(coalesce(n_lines, 0), 1) end as affinity_{k.lower()}"
                   for k in KINDS)}
        from customer left join order_history h on c_custkey = h.user_id
        left join user_tastes t on c_custkey = t.user_id
        left join user_favourite f on c_custkey = f.user_id
        left join user_web w on c_custkey = w.user_id""",
    "part_sales": """
        select l_partkey, count(*) as n, sum(l_quantity) as q,
               sum(case when l_linestatus = 'O' then l_quantity else 0 end) as q_open,
               avg(l_discount) as discount, min(l_shipdate) as first_shipped, max(l_shipdate) as last_shipped,
               count(*) filter (where l_returnflag = 'R') as n_returned,
               count(*) filter (where l_shipdate >= (select max(l_shipdate) from lineitem) - interval 365 day) as n_year,
               count(*) filter (where month(l_shipdate) = month((select max(l_shipdate) from lineitem))) as n_month
        from lineitem group by 1""",
    "raw_products": """
        select p_partkey as product_id, p_type as category, p_brand as brand,
               p_retailprice * p_size / 50 as base_price,
               p_retailprice * p_size / 50 * (1 - coalesce(discount, 0)) as current_price,
               p_retailprice * p_size / 50 * (0.3::double + 0.03::double * (p_partkey % 10)) as cost_price,
               coalesce(q_open, 0)::int as current_stock, coalesce(q, 0)::int as initial_stock,
               p_size as reorder_threshold,
               coalesce(date_diff('day', last_shipped::date, (select max(l_shipdate) from lineitem)::date), 0)::int as days_on_shelf,
               5 - 2.5::double * (coalesce(n_returned, 0)::double / greatest(coalesce(n, 0), 1)) as avg_rating,
               coalesce(n, 0)::bigint as review_count,
               least(1.0::double, 4 * (coalesce(n_year, 0)::double / greatest(coalesce(n, 0), 1))) as trend_score,
               coalesce((first_shipped >= date '1995-07-01')::int, 0)::int as is_new_launch,
               (p_partkey % 20)::int as style_cluster,
               least(1.0::double, 5 * (coalesce(n_month, 0)::double / greatest(coalesce(n, 0), 1))) as seasonal_relevance
        from part left join part_sales on p_partkey = l_partkey""",
    "products": f"""
        select *,
               {rnd("least(greatest((initial_stock - current_stock)::double / greatest(initial_stock, 1), 0.0::double), 1.0::double)", 3)} as sell_through_rate,
               {rnd("least(greatest((current_price - cost_price) / greatest(current_price, 0.01::double), 0.0::double), 1.0::double)", 3)} as margin_score
        from raw_products""",
    "ship": """
        select null::bigint as event_id, o_custkey as user_id, l_partkey as product_id, l_shipdate as ts,
               'purchase' as event_type, l_extendedprice * (1 - l_discount) / greatest(l_quantity, 1) as price_paid,
               l_quantity::int as quantity, 'ship' as source
        from lineitem join orders on l_orderkey = o_orderkey""",
    "web": f"""
        select event_id, user_id, (props->>'$.k')::bigint as product_id, ts,
               {case("event_type", WEB_EVENT_TYPES, "null")} as event_type, value as price_paid, 1::int as quantity,
               'web' as source
        from events where event_type in ({", ".join(f"'{t}'" for t in WEB_EVENT_TYPES)})""",
    "all_events": "select * from ship union all select * from web",
    "exps": """
        select l_partkey as product_id, l_discount as discount_pct,
               l_quantity / 500 + 0.55::double * l_discount as conversion_rate,
               (l_discount >= 0.05::double)::int as treated
        from lineitem""",
    "history": """
        select user_id,
               count(*) filter (where ts >= (select max(l_shipdate) from lineitem) - interval 30 day) as purchase_count_30d,
               avg(price_paid) as avg_price_paid
        from ship group by 1""",
    "user_features": f"""
        select u.*, coalesce(h.purchase_count_30d, 0)::bigint as purchase_count_30d,
               coalesce(h.avg_price_paid, u.avg_order_value) as avg_price_paid,
               {segment_code("segment")} as segment_encoded
        from users u left join history h using (user_id)""",
    "product_features": f"select *, {category_code('category')} as category_encoded from products",
    "inventory": """
        select product_id, current_stock::double / greatest(initial_stock, 1) as stock_ratio, sell_through_rate,
               days_on_shelf::double as days_on_shelf,
               least(greatest(days_on_shelf / 180.0::double, 0.0::double), 1.0::double) as days_normalized,
               greatest(current_stock - reorder_threshold, 0)::double / greatest(initial_stock, 1) as stock_buffer,
               trend_score, seasonal_relevance, margin_score, category_encoded::double as category_encoded,
               least(greatest(days_on_shelf / 180.0::double, 0.0::double), 1.0::double) * (1 - sell_through_rate) as ageing_score
        from product_features""",
    "pressure": """
        select product_id,
               least(greatest(0.35::double * ageing_score + 0.30::double * (1 - sell_through_rate)
                 + 0.20::double * days_normalized + 0.10::double * (1 - trend_score)
                 + 0.05::double * (1 - least(greatest(stock_buffer, 0.0::double), 1.0::double)), 0.0::double), 1.0::double) as inventory_pressure
        from inventory""",
    "daily": "select l_partkey as product_id, l_shipdate::date as sale_day, count(*) as daily_demand from lineitem group by 1, 2",
    "rolling": """
        select product_id, sale_day, daily_demand,
               row_number() over d as day_no,
               coalesce(sum(daily_demand) over (d rows between 7 preceding and 1 preceding), 0)::bigint as demand_7d,
               coalesce(sum(daily_demand) over (d rows between 14 preceding and 1 preceding), 0)::bigint as demand_14d,
               coalesce(sum(daily_demand) over (d rows between 30 preceding and 1 preceding), 0)::bigint as demand_30d,
               coalesce(sum(daily_demand) over (d rows between 14 preceding and 8 preceding), 0)::bigint as previous_7d,
               case when count(*) over (d rows between current row and 6 following) = 7
                    then sum(daily_demand) over (d rows between current row and 6 following) end::bigint as target_demand_7d
        from daily window d as (partition by product_id order by sale_day)""",
    "training_days": "select * from rolling where day_no > 14 and target_demand_7d is not null",
    "training_set": f"""
        select t.product_id, t.sale_day, demand_7d, demand_14d, demand_30d,
               {velocity("demand_7d", "previous_7d")} as velocity,
               (isodow(sale_day) - 1)::int as day_of_week, month(sale_day)::int as month,
               (isodow(sale_day) >= 6)::int as is_weekend,
               coalesce(trend_score, 0.5) as trend_score, coalesce(avg_rating, 3.5) as avg_rating,
               coalesce(seasonal_relevance, 0.5) as seasonal_relevance, coalesce(is_new_launch, 0)::int as is_new_launch,
               coalesce(base_price, 50.0) as base_price, coalesce(category_encoded, 0)::int as category_encoded,
               target_demand_7d
        from training_days t left join product_features using (product_id)""",
    "baseline": """
        select product_id, avg(demand_7d) as baseline, max(target_demand_7d) as max_target, count(*) as n_samples
        from training_days group by 1""",
    "tails": """
        select product_id, sum(daily_demand) filter (where r <= 7) as demand_7d,
               sum(daily_demand) filter (where r <= 14) as demand_14d, sum(daily_demand) filter (where r <= 30) as demand_30d,
               case when count(*) >= 14 then sum(daily_demand) filter (where r between 8 and 14)
                    else sum(daily_demand) filter (where r <= 7) end as previous_7d
        from (select *, row_number() over (partition by product_id order by sale_day desc) as r from daily) group by 1""",
    "latest": f"""
        with day as (select max(l_shipdate)::date as d from lineitem)
        select product_id, coalesce(demand_7d, 0)::double as demand_7d, coalesce(demand_14d, 0)::double as demand_14d,
               coalesce(demand_30d, 0)::double as demand_30d,
               coalesce({velocity("demand_7d", "previous_7d")}, 0)::double as velocity,
               {", ".join(
                   f"case when demand_7d is null then 0 else {value} end::double as {name}"
                   for name, value in [
                       ("day_of_week", "isodow(d) - 1"), ("month", "month(d)"),
                       ("is_weekend", "(isodow(d) >= 6)::int"), ("trend_score", "trend_score"),
                       ("avg_rating", "avg_rating"), ("seasonal_relevance", "seasonal_relevance"),
                       ("is_new_launch", "is_new_launch"), ("base_price", "base_price"),
                       ("category_encoded", "category_encoded")])}
        from product_features left join tails using (product_id), day""",
    "spikes": f"""
        select product_id,
               {rnd("least(1.0::double, demand_7d / ((case when coalesce(baseline, 0) = 0 then 1.0 else baseline end) * 1.5::double))", 4)} as demand_spike
        from latest left join baseline using (product_id) join products p using (product_id)""",
    "arm_lines": """
        select category, treated, regr_slope(conversion_rate, discount_pct) as slope,
               regr_intercept(conversion_rate, discount_pct) as intercept, count(*) as n
        from exps join products using (product_id) group by 1, 2""",
    "lines": """
        select category, max(intercept) filter (where treated = 0) as c0, max(intercept) filter (where treated = 1) as t0,
               max(slope) filter (where treated = 1) as t1
        from arm_lines group by 1""",
    "grid": f"""
        select product_id, current_price, cost_price, i * 5 / 100.0::double as discount,
               {rnd("coalesce(greatest(0.0::double, t0 + t1 * (i * 5 / 100.0::double) - c0), 0.0::double)", 4)} as uplift,
               (current_price - cost_price) / (current_price + 1e-6::double) as unit_margin
        from products left join lines using (category), range(0, 11) r(i)""",
    "best": f"""
        select product_id, discount as optimal_discount_pct, uplift as expected_uplift,
               {rnd("discount * 0.5::double", 4)} as expected_margin_loss,
               {rnd("discount * unit_margin", 4)} as true_margin_loss
        from grid
        qualify row_number() over (partition by product_id
            order by 0.5::double * uplift - 0.5::double * (discount * unit_margin) desc, discount) = 1""",
    "negatives": """
        select * from web where event_type in ('view', 'wishlist')
        qualify row_number() over (order by md5(event_id::varchar), event_id)
            <= 3 * (select count(*) from web where event_type = 'purchase')""",
    "samples": """
        select *, 1::int as label from web where event_type = 'purchase'
        union all select *, 0::int as label from negatives""",
    "rates": """
        select segment, category, count(*) as n_samples, sum(label)::bigint as n_purchases,
               (sum(label) + 1)::double / (count(*) + 2) as rate
        from samples join users using (user_id) join products using (product_id) group by 1, 2""",
    "catalogue": """
        select p.*, inventory_pressure, demand_spike, optimal_discount_pct, expected_uplift,
               row_number() over (order by substr(md5(product_id::varchar), 1, 4), product_id) - 1 as product_index
        from products p join pressure using (product_id) join spikes using (product_id) join best using (product_id)""",
    "presets": "select * from (values "
    + ", ".join(
        "('{name}', '{description}', ".format(**p)
        + ", ".join(f"{p[w]}::double" for w in WEIGHTS)
        + ")"
        for p in fixed.PRESETS
    )
    + ") t(preset, description, propensity, inventory, margin, trend, demand_spike_weight, diversity)",
    "requests": f"""
        select o_orderkey as request_id, o_custkey as user_id, floor(o_totalprice / 4000)::int as top_k,
               floor(o_totalprice / 900)::int as candidate_pool,
               {case("o_orderpriority", REQUEST_PRESETS, "null")} as weight_preset,
               o_orderstatus = 'O' as apply_diversity
        from orders""",
}


def walk(requests: str) -> str:
    """Candidate positions of every request."""
    return f"""
        with shelf as (select count(*) as n from products),
        turns as (
            select r.*, n, {hash_number("user_id::varchar")} as start,
                   ('0x' || substr(md5(user_id::varchar), 9, 8))::bigint as turn,
                   list_filter({STRIDES}::bigint[], lambda s: n % s <> 0) as usable
            from {requests} r, shelf)
        select * exclude (start, turn, usable, n, i),
               (start + i * usable[1 + turn % len(usable)]) % n as product_index
        from (select *, unnest(range(0, least(candidate_pool, n)::bigint)) as i from turns)"""


def scored(candidates: str) -> str:
    """Signals, weights and the weighted score of candidate rows."""
    total = rnd(
        "propensity * propensity_score + inventory * inventory_pressure + margin * margin_score"
        " + trend * trend_score + demand_spike_weight * demand_spike",
        6,
    )
    return f"""
        select *, {total} as score, style_cluster as cluster, {tier("current_price")} as tier
        from (select c.*, k.* exclude (product_index), w.*, coalesce(rate, 0.5::double) as propensity_score
              from {candidates} c join catalogue k using (product_index) join users u using (user_id)
              left join rates r on r.segment = u.segment and r.category = k.category
              join presets w on w.preset = (case when c.weight_preset in (select preset from presets) then c.weight_preset else 'balanced' end))"""


def mmr(source: str, rid: str, steps: int) -> dict[str, str]:
    """Unrolled greedy picks of (rid, product_id, score, cluster, category, tier, diversity)."""
    parts = {
        "left_0": f"select {rid}, product_id, score, cluster, category, tier, diversity, 0.0::double as pen from {source}"
    }
    for t in range(1, steps + 1):
        parts[f"pick_{t}"] = f"""
            select * from left_{t - 1}
            qualify row_number() over (partition by {rid} order by score - pen desc, score desc, product_id) = 1"""
        worse = rnd(f"c.diversity * {similarity('c', 'p')}", 4)
        parts[f"left_{t}"] = f"""
            select c.* exclude (pen), greatest(c.pen, {worse}) as pen
            from left_{t - 1} c join pick_{t} p using ({rid}) where c.product_id <> p.product_id"""
    parts["all_picks"] = " union all ".join(
        f"select *, {t}::int as rank, score - pen as pick_score from pick_{t}" for t in range(1, steps + 1)
    )
    worse = rnd(f"a.diversity * {similarity('a', 'b')}", 4)
    parts["picks"] = f"""
        select {rid}, rank, product_id, any_value(score) as raw_score, {rnd("any_value(pick_score)", 6)} as pick_score,
               greatest(0.0::double, any_value(score) - coalesce(max(worse), 0.0::double)) as kept
        from (select a.{rid}, a.rank, a.product_id, a.pick_score, a.score,
                     case when a.product_id <> b.product_id then {worse} end as worse
              from all_picks a join all_picks b using ({rid}))
        group by 1, 2, 3"""
    return parts


def with_clause(body: str, parts: dict[str, str] | None = None) -> str:
    """The body with the CTEs it needs in front, each after those it reads itself."""
    known = {**CTES, **(parts or {})}
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\b(?:from|join)\s+(\w+)", text):
            if name in known and name not in order:
                need(known[name])
                if name not in order:
                    order.append(name)

    need(body)
    ctes = ",\n".join(f"{name} as materialized ({known[name].strip()})" for name in order)
    return f"with {ctes}\n{body}" if ctes else body


def round_all(columns: dict[str, int | None]) -> str:
    """Select list: each column rounded to its places, or as it is."""
    return ", ".join(
        name if places is None else f"{rnd(name, places)} as {name}"
        for name, places in columns.items()
    )


def at(places: int, *names: str) -> str:
    return round_all({name: places for name in names})


USER_DOUBLES = [
    "avg_order_value", "lifetime_spend", "price_sensitivity", "cart_abandon_rate", *AFFINITIES,
]
USER_OTHERS = [
    "user_id", "recency_days", "purchase_freq_90d", "account_age_days", "sessions_7d", "segment",
    "preferred_category",
]
PRODUCT_DOUBLES = [
    "base_price", "current_price", "cost_price", "avg_rating", "trend_score",
    "seasonal_relevance", "sell_through_rate", "margin_score",
]
PRODUCT_OTHERS = [
    "product_id", "category", "brand", "current_stock", "initial_stock", "reorder_threshold",
    "days_on_shelf", "review_count", "is_new_launch", "style_cluster",
]
USER_VECTOR = [
    *fixed.USER_BASE, "segment_encoded", "purchase_count_30d", "avg_price_paid", *AFFINITIES,
]

PAIR_REQUESTS = f"""
    select event_id as request_id, user_id, floor(price_paid * 10)::bigint as product_id,
           case when bucket < 40 then 'balanced' when bucket < 60 then 'lenskart' when bucket < 80 then 'dyson' else 'amazon' end as weight_preset
    from (select *, {hash_number("'ranking_weights:' || user_id::varchar")} % 100 as bucket from web)"""

PAIR_SCORES = """
    select q.request_id, q.user_id as wanted_user, q.product_id as wanted_product, q.weight_preset, k.*, w.*,
           u.user_id is not null and k.product_id is not null as known,
           coalesce(rate, 0.5::double) as propensity_score
    from pair_requests q left join users u on u.user_id = q.user_id left join catalogue k on k.product_id = q.product_id
    left join rates r on r.segment = u.segment and r.category = k.category
    join presets w on w.preset = q.weight_preset"""

TOTAL = (
    "propensity * propensity_score + inventory * inventory_pressure + margin * margin_score"
    " + trend * trend_score + demand_spike_weight * demand_spike"
)

BREAKDOWN = {
    "propensity": "propensity * propensity_score",
    "inventory": "inventory * inventory_pressure",
    "margin": "margin * margin_score",
    "trend": "trend * trend_score",
    "demand_spike": "demand_spike_weight * demand_spike",
}


def asked(**options: str) -> str:
    values = {
        "top_k": "20", "candidate_pool": "100", "weight_preset": "'balanced'",
        "apply_diversity": "true", **options,
    }
    return "select c_custkey as request_id, c_custkey as user_id, " + ", ".join(
        f"{value} as {name}" for name, value in values.items()
    ) + " from customer"


def ranking(requests: str, steps: int, diverse: bool = True, rid: str = "request_id") -> dict[str, str]:
    """CTEs from requests to ``ranked``, a recommendation result before rounding."""
    parts = {"asked": requests, "walked": walk("asked"), "scored": scored("walked")}
    if diverse:
        parts.update(mmr("scored", rid, steps))
    else:
        parts["picks"] = f"""
            select {rid}, row_number() over (partition by {rid} order by score desc, product_id)::int as rank,
                   product_id, score as pick_score, score as kept from scored
            qualify rank <= {steps}"""
    parts["ranked"] = f"""
        select s.*, p.rank, p.pick_score, {rnd("p.kept", 6)} as kept,
               n.total_candidates, {rnd(rnd("p.kept", 6), 4)} as final_score
        from picks p join scored s using ({rid}, product_id)
        join (select {rid}, count(*) as total_candidates from scored group by 1) n using ({rid})"""
    return parts


def whole(requests: str, steps: int) -> dict[str, str]:
    """CTEs to ``of_segment``: the list of one user of each segment, given to all its users."""
    parts = ranking(requests, steps)
    parts["walked"] = "select a.*, product_index from asked a cross join (select product_index from catalogue)"
    parts["of_segment"] = """
        select r.* exclude (user_id), u.user_id from ranked r
        join users v on v.user_id = r.user_id join users u on u.segment = v.segment"""
    return parts


RANKED = f"""
    user_id, rank, product_id, {rnd("pick_score", 6)} as pick_score, final_score,
    {", ".join(f"{rnd(c, 4)} as {c}" for c in ["propensity_score", "inventory_pressure", "margin_score", "trend_score", "demand_spike"])},
    inventory_pressure >= 0.65::double as should_show_sale_badge, {urgency("inventory_pressure")} as urgency_label,
    {rnd("optimal_discount_pct", 6)} as optimal_discount_pct, category, brand, {rnd("current_price", 2)} as current_price,
    {rnd("base_price", 2)} as base_price, {rnd("avg_rating", 6)} as avg_rating, weight_preset as weights_used, total_candidates,
    {", ".join(f"{rnd(value, 4)} as part_{name}" for name, value in BREAKDOWN.items())}"""

POOL = {"asked": asked(), "walked": walk("asked"), "scored": scored("walked")}
EVERY_PRESET = """
    select c_custkey::varchar || ':' || preset as request_id, c_custkey as user_id, 5 as top_k, 100 as candidate_pool,
           preset as weight_preset, true as apply_diversity
    from customer cross join presets"""

DRIFT = {
    "user_values": f"""
        unpivot (select {", ".join(f"{c}::double as {c}" for c in USER_DOUBLES + ["recency_days", "purchase_freq_90d", "account_age_days", "sessions_7d"])} from users)
        on columns(*) into name feature value value""",
    "user_texts": "unpivot (select segment, preferred_category from users) on columns(*) into name feature value value",
    "edge_lists": """
        select feature, list_sort(list_distinct(list(edge))) as edges
        from (select feature, unnest(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) as edge
              from user_values group by feature) group by 1""",
    "bin_counts": """
        select feature, least(len(list_filter(edges, lambda e: value >= e)), len(edges) - 1) as bin_no, count(*) as n
        from user_values join edge_lists using (feature)
        where value between edges[1] and edges[len(edges)] and len(edges) > 1 group by 1, 2""",
    "bins": """
        select feature, b.bin_no::int as bin_no, low, high, coalesce(n, 0)::bigint as n,
               coalesce(n, 0)::double / sum(coalesce(n, 0)) over (partition by feature) as share
        from (select feature, unnest(range(1, len(edges))) as bin_no, edges[bin_no] as low, edges[bin_no + 1] as high
              from edge_lists where len(edges) > 1) b left join bin_counts using (feature, bin_no)""",
    "user_stats": "select feature, avg(value) as mean, stddev_samp(value) as std, count(*) as n_values from user_values group by 1",
    "text_shares": """
        select feature, value, count(*) as n, count(*)::double / sum(count(*)) over (partition by feature) as share
        from user_texts group by 1, 2""",
}

TWO = {}
for _name, _source in (("ref", "ship"), ("cur", "web")):
    TWO[f"{_name}_rows"] = f"""
        select price_paid::double as price_paid, quantity::double as quantity, (isodow(ts) - 1)::double as weekday,
               day(ts)::double as month_day, event_type, case when month(ts) <= 6 then 'first' else 'second' end as half_year,
               strftime(ts, '%a') as day_name
        from {_source}"""
    TWO[f"{_name}_values"] = f"""
        unpivot (select price_paid, quantity, weekday, month_day from {_name}_rows) on columns(*) into name feature value value"""
    TWO[f"{_name}_texts"] = f"""
        unpivot (select event_type, half_year, day_name from {_name}_rows) on columns(*) into name feature value value"""
TWO["ref_edges"] = DRIFT["edge_lists"].replace("user_values", "ref_values")
for _name in ("ref", "cur"):
    TWO[f"{_name}_bins"] = (
        DRIFT["bin_counts"].replace("user_values", f"{_name}_values").replace("edge_lists", "ref_edges")
    )
TWO["psi_terms"] = """
    select b.feature, greatest(coalesce(r.n, 0)::double / sum(coalesce(r.n, 0)) over (partition by b.feature), 1e-10::double) as p,
           greatest(coalesce(c.n, 0)::double / (sum(coalesce(c.n, 0)) over (partition by b.feature) + 1e-10::double), 1e-10::double) as q
    from (select feature, unnest(range(1, len(edges))) as bin_no from ref_edges where len(edges) > 1) b
    left join ref_bins r using (feature, bin_no) left join cur_bins c using (feature, bin_no)"""
TWO["psi_table"] = f"""
    select feature, {rnd("coalesce(any_value(psi), 0)", 6)} as psi,
           count(*) filter (where value < edges[1] or value > edges[len(edges)]) as out_of_range_count
    from cur_values join ref_edges using (feature)
    left join (select feature, sum((q - p) * ln(q / p)) as psi from psi_terms group by 1) t using (feature) group by 1"""
TWO["psi_levels"] = """
    select *, case when psi >= 0.25::double then 'critical' when psi >= 0.10::double then 'warning' else 'none' end as level
    from psi_table"""
TWO["chi_rows"] = """
    select r.feature, r.share, coalesce(c.n, 0) as observed, sum(coalesce(c.n, 0)) over (partition by r.feature) as size
    from (select feature, value, count(*)::double / sum(count(*)) over (partition by feature) as share from ref_texts group by 1, 2) r
    left join (select feature, value, count(*) as n from cur_texts group by 1, 2) c using (feature, value)"""

# Quantiles of chi-square decide the level.  Its p-value is SQL here only far out, where it is
# zero to all places that are shown; nearer ones come out as null.
ALERTS = {
    **TWO,
    "chi_alerts": """
        select feature, statistic > q99 as critical, case when statistic > 60 then 0.0::double end as p
        from (select feature, sum(pow(observed + 1e-10::double - (share * size + 1e-10::double), 2) / (share * size + 1e-10::double)) as statistic,
                     count(*) - 1 as dof from chi_rows group by 1)
        join (values (1, 3.841458820694124, 6.634896601021213), (2, 5.991464547107979, 9.210340371976180),
                     (3, 7.814727903251179, 11.34486673014437), (4, 9.487729036781154, 13.27670413598760),
                     (5, 11.07049769351635, 15.08627246938899), (6, 12.59158724374398, 16.81189382977093)) q(dof, q95, q99) using (dof)
        where statistic > q95""",
    "paid": """
        select event_type, abs(avg(price_paid) - (select avg(price_paid) from ref_rows))
               / ((select stddev_samp(price_paid) from ref_rows) + 1e-10::double) as z
        from web group by 1""",
    "alerts": f"""
        select feature, 'PSI' as metric, psi as value, 0.1::double as threshold, level,
               format('Distribution shift detected in ''{{}}'' (PSI={{:.4f}})', feature, psi) as message
        from psi_levels where level <> 'none'
        union all
        select feature, 'chi2_pvalue', p, case when critical then 0.01 else 0.05 end::double,
               case when critical then 'critical' else 'warning' end,
               case when critical then 'Categorical distribution shift' else 'Possible categorical drift' end
               || format(' in ''{{}}'' (p={{:.6f}})', feature, p)
        from chi_alerts
        union all
        select event_type, 'zscore', {rnd("z", 4)}, case when z > 3 then 3 else 2 end::double,
               case when z > 3 then 'critical' else 'warning' end,
               case when z > 3 then 'Score distribution anomaly' else 'Score distribution warning' end
               || format(': mean shifted {{:.1f}}σ from baseline', z)
        from paid where z > 2""",
}

# Weeks of web events that are over when the stream has ended, each against the reference.
WINDOWS = {
    **TWO,
    "week_rows": TWO["cur_rows"].replace("select price_paid", "select floor(epoch(ts) / 604800)::bigint as week, price_paid"),
    "week_values": """
        unpivot (select week, price_paid, quantity, weekday, month_day from week_rows)
        on price_paid, quantity, weekday, month_day into name feature value value""",
    "week_bins": """
        select week, feature, case when value between edges[1] and edges[len(edges)]
                   then least(len(list_filter(edges, lambda e: value >= e)), len(edges) - 1) else 0 end as bin_no, count(*) as n
        from week_values join ref_edges using (feature)
        where (epoch((select max(ts) from web)) - 604800) >= (week + 1) * 604800 group by 1, 2, 3""",
    "week_terms": """
        select g.week, b.feature,
               greatest(coalesce(r.n, 0)::double / sum(coalesce(r.n, 0)) over (partition by g.week, b.feature), 1e-10::double) as p,
               greatest(coalesce(c.n, 0)::double / (sum(coalesce(c.n, 0)) over (partition by g.week, b.feature) + 1e-10::double), 1e-10::double) as q
        from (select distinct week, feature from week_bins) g
        join (select feature, unnest(range(1, len(edges))) as bin_no from ref_edges where len(edges) > 1) b using (feature)
        left join ref_bins r on r.feature = b.feature and r.bin_no = b.bin_no
        left join week_bins c on c.week = g.week and c.feature = b.feature and c.bin_no = b.bin_no""",
    "week_psi": "select week, feature, sum((q - p) * ln(q / p)) as psi from week_terms group by 1, 2",
}

# Bucket of nearly equal values, and the values of the reference in such buckets.
BUCKET = "case when value = 0 then 0 else sign(value) * (floor(ln(abs(value)) / ln(1.002::double)) + 400000) end::bigint"
MERGED = {
    **TWO,
    "buckets": f"select feature, {BUCKET} as bucket, min(value) as low, max(value) as high, count(*) as n from ref_values group by 1, 2",
    "running": """
        select *, sum(n) over (partition by feature order by bucket) - n as below, sum(n) over (partition by feature) as total
        from buckets""",
    "starts": """
        select feature, low as edge, any_value(below) as below
        from running, range(0, 10) t(i)
        where floor((total - 1) * i / 10) >= below and floor((total - 1) * i / 10) < below + n group by 1, 2
        union all
        select feature, max(high), max(total) from running group by 1""",
    "merged_edges": "select feature, edge, min(below) as below from starts group by 1, 2",
    "merged_bins": """
        select * from (
            select feature, row_number() over (partition by feature order by edge) as bin_no, edge as low,
                   case when lead(edge, 2) over (partition by feature order by edge) is null
                        then max(total) over (partition by feature) else lead(below) over (partition by feature order by edge) end - below as n,
                   lead(edge) over (partition by feature order by edge) as high
            from merged_edges join (select feature, any_value(total) as total from running group by 1) using (feature))
        where high is not null""",
}

RUNS = {
    "run_base": f"""
        select 'status_' || l_linestatus as experiment, l_returnflag || '_' || year(l_shipdate)::varchar as run_name,
               l_returnflag, year(l_shipdate) as ship_year, count(*) as n_lines, {rnd("avg(l_discount)", 6)} as mean_discount,
               {rnd("avg(l_quantity)", 6)} as mean_quantity, min(l_shipdate) as start_time, max(l_shipdate) as end_time
        from lineitem group by 1, 2, 3, 4""",
    "run_maps": f"""
        select experiment, run_name, 'params' as kind, 'return_flag' as key, null::double as number, l_returnflag as text from run_base
        union all select experiment, run_name, 'params', 'ship_year', null, ship_year::varchar from run_base
        union all select experiment, run_name, 'metrics', 'n_lines', {rnd("n_lines", 4)}, null from run_base
        union all select experiment, run_name, 'metrics', 'mean_discount', {rnd("mean_discount", 4)}, null from run_base
        union all select experiment, run_name, 'metrics', 'mean_quantity', {rnd("mean_quantity", 4)}, null from run_base where ship_year >= 1998
        union all select experiment, run_name, 'tags', 'summary', null, 'lines of ' || run_name from run_base""",
}

BOTH_STORES = f"""
    select 'users' as store, user_id as id, {rnd("avg_price_paid", 4)} as value from user_features
    union all select 'products', product_id, {rnd("margin_score", 4)} from product_features"""


def best(metric: str, mode: str, having: str = "true") -> str:
    order = "desc" if mode == "max" else "asc"
    return f"""
        select '{metric}' as metric, '{mode}' as mode, experiment, run_name, n_runs::bigint as n_runs, {rnd(metric, 4)} as value
        from (select *, count(*) over (partition by experiment) as n_runs,
                     row_number() over (partition by experiment order by {metric} {order}, run_name) as r
              from run_base where {having}) where r = 1"""


# Query name to its SQL, or to the SQL and the CTEs it needs besides the shared ones.
BODIES: dict[str, str | tuple[str, dict[str, str]]] = {
    # Sources
    "load_tables": """
        select 'users' as name, count(*) as n_rows from users union all select 'products', count(*) from products
        union all select 'events', count(*) from all_events union all select 'experiments', count(*) from exps""",
    "users_view": f"select {', '.join(USER_OTHERS)}, {at(4, *USER_DOUBLES)} from users",
    "products_view": f"select {', '.join(PRODUCT_OTHERS)}, {at(4, *PRODUCT_DOUBLES)} from products",
    "events_view": f"select * replace ({rnd('price_paid', 4)} as price_paid) from all_events",
    "experiments_view": f"select product_id, {at(6, 'discount_pct', 'conversion_rate')} from exps",
    "write_runs": (
        """select experiment, run_name, strftime(start_time, '%Y-%m-%dT%H:%M:%S') as start_time,
                  strftime(end_time, '%Y-%m-%dT%H:%M:%S') as end_time from run_base""",
        RUNS,
    ),
    "read_runs": (
        """select * from run_maps union all
           select distinct 'status_' || l_linestatus, null, 'corrupt', null, null::double,
                  '{"run_name": "cut_status_' || l_linestatus || '", "params": {"a' from lineitem""",
        RUNS,
    ),
    "log_run": ("select * from run_maps", RUNS),
    "feature_tables": BOTH_STORES,
    "save_load_model": """
        select 'propensity' as model, count(*) as n_rows, 0::bigint as n_different
        from samples join users using (user_id) join products using (product_id)
        union all select m, count(*), 0 from products, (values ('elasticity'), ('inventory'), ('demand')) t(m) group by 1""",
    # Projections
    "sell_through_rate": "select product_id, sell_through_rate from products",
    "margin_score": "select product_id, margin_score from products",
    "affinity_boost": f"select user_id, preferred_category, {at(6, *AFFINITIES)} from users",
    "segment_encode": f"select user_id, {segment_code('segment')} as segment_encoded from users",
    "category_encode": f"select p_partkey as product_id, {category_code('p_type')} as category_encoded, 0::int as unlisted_encoded from part",
    "user_vector": "select user_id, "
    + ", ".join(f"{rnd(c, 4)} as v{i:02d}" for i, c in enumerate(USER_VECTOR))
    + " from user_features",
    "product_vector": "select product_id, "
    + ", ".join(f"{rnd(c, 4)} as v{i:02d}" for i, c in enumerate(fixed.PRODUCT_VECTOR))
    + " from products",
    "pad_or_trim": "select product_id, 17::int as n_padded, 5::int as n_trimmed, "
    + ", ".join(f"{rnd(c, 4)} as p{i:02d}" for i, c in enumerate(fixed.PRODUCT_VECTOR + ["0", "0", "0"]))
    + ", "
    + ", ".join(f"{rnd(c, 4)} as t{i:02d}" for i, c in enumerate(fixed.PRODUCT_VECTOR[:5]))
    + " from products",
    "price_ratio": f"""
        select event_id, {rnd("avg_order_value / (current_price + 1e-6::double)", 4)} as price_ratio
        from web join users using (user_id) join products using (product_id)""",
    "inventory_features": f"select product_id, {at(6, *fixed.INVENTORY_COLUMNS)} from inventory",
    "pressure_label": f"select product_id, {at(6, 'inventory_pressure')} from pressure",
    "urgency_label": f"select product_id, {urgency('inventory_pressure')} as urgency_label from pressure",
    "sale_badge": "select product_id, inventory_pressure >= 0.65::double as should_show_sale_badge from pressure",
    "price_tier": f"select product_id, {tier('current_price')} as price_tier from products",
    "treatment_arm": "select product_id, discount_pct, treated from exps",
    "purchase_label": "select event_id, (event_type = 'purchase')::int as label from web",
    "time_features": """
        select event_id, (isodow(ts) - 1)::int as day_of_week, month(ts)::int as month, (isodow(ts) >= 6)::int as is_weekend
        from web""",
    "demand_velocity": f"""
        select product_id, day_no::int as day_no, {rnd(velocity("demand_7d", "previous_7d"), 6)} as velocity
        from rolling where day_no > 14""",
    "score_breakdown": (
        f"""select request_id, wanted_user as user_id, wanted_product as product_id,
            {", ".join(f"{rnd(v, 4)} as {n}" for n, v in BREAKDOWN.items())} from pair_scores where known""",
        {"pair_requests": PAIR_REQUESTS, "pair_scores": PAIR_SCORES},
    ),
    "storefront_flags": (
        f"""select user_id, product_id, {rnd("demand_spike", 4)} > 0.7::double as show_trending,
            {rnd("current_price", 2)} < {rnd("base_price", 2)} as show_markdown,
            {rnd("least(final_score * 100, 100.0::double)", 4)} as score_bar, optimal_discount_pct > 0 as show_discount
            from ranked""",
        ranking(asked(), 20),
    ),
    "elasticity_features": f"""
        select product_id, {at(4, 'base_price', 'avg_rating', 'margin_score', 'trend_score')}, review_count, is_new_launch, category_encoded
        from product_features""",
    "propensity_features": "select event_id, "
    + at(4, *fixed.USER_BASE, *AFFINITIES, *fixed.PRODUCT_TRAINING, "segment_encoded", "category_encoded")
    + f", {rnd('avg_order_value / (current_price + 1e-6::double)', 4)} as price_ratio"
    + " from web join user_features using (user_id) join product_features using (product_id)",
    "standard_scale": (
        "select product_id, split, "
        + ", ".join(
            f"{rnd(f'({c} - m_{c}) / (case when s_{c} = 0 then 1 else s_{c} end)', 4)} as {c}"
            for c in fixed.INVENTORY_COLUMNS
        )
        + " from parts cross join stats",
        {
            "parts": f"select *, case when {hash_number('product_id::varchar')} % 100 < 80 then 'train' else 'val' end as split from inventory",
            "stats": "select "
            + ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in fixed.INVENTORY_COLUMNS)
            + " from parts where split = 'train'",
            },
    ),
    "impute_defaults": (
        f"""select request_id, product_id, {rnd("coalesce(trend_score, 0.5)", 4)} as trend_score,
            {rnd("coalesce(avg_rating, 3.5)", 4)} as avg_rating, {rnd("coalesce(seasonal_relevance, 0.5)", 4)} as seasonal_relevance,
            coalesce(is_new_launch, 0)::int as is_new_launch, {rnd("coalesce(base_price, 50)", 4)} as base_price,
            coalesce(category_encoded, 0)::int as category_encoded
            from pair_requests left join product_features using (product_id)""",
        {"pair_requests": PAIR_REQUESTS},
    ),
    # Filters
    "purchases_only": f"select event_id, user_id, product_id, {at(6, 'price_paid')} from web where event_type = 'purchase'",
    "negatives_only": "select event_id, user_id, product_id, event_type from web where event_type in ('view', 'wishlist')",
    "recent_window": f"""
        select user_id, product_id, ts, {at(4, 'price_paid')}, quantity from ship
        where ts >= (select max(l_shipdate) from lineitem) - interval 30 day""",
    "numeric_columns": f"""
        select feature, count(*) as n, {rnd("min(value)", 4)} as low, {rnd("max(value)", 4)} as high
        from (unpivot (select {", ".join(f"{c}::double as {c}" for c in PRODUCT_DOUBLES + PRODUCT_OTHERS[3:])} from products)
              on columns(*) into name feature value value) group by 1
        union all select 'category', count(*), null, null from products
        union all select 'brand', count(*), null, null from products""",
    "drop_nulls": f"""
        select 'balance' as feature, count(c_acctbal) as n_values, {rnd("avg(c_acctbal)", 6)} as mean from customer
        union all select 'avg_price_paid', count(*), {rnd("avg(v)", 6)}
          from (select avg(price_paid) as v from web join customer on c_custkey = user_id where event_type = 'purchase' group by user_id)
        union all select 'last_viewed_product', count(*), {rnd("avg(product_id)", 6)}
          from (select product_id from web join customer on c_custkey = user_id where event_type = 'view'
                qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)""",
    "feature_lookup": (
        f"""select product_id, category, {at(4, 'base_price', 'margin_score')}
            from (select distinct product_id from pair_requests) left join products using (product_id)""",
        {"pair_requests": PAIR_REQUESTS},
    ),
    "validate_requests": """
        select *, case when user_id is null then 'user_id' when top_k not between 1 and 100 then 'top_k'
                       when candidate_pool not between 10 and 500 then 'candidate_pool' end as reject_reason
        from requests""",
    # Joins
    "training_pairs": f"""
        select event_id, user_id, product_id, label,
               {at(4, 'avg_order_value', 'segment_encoded', 'current_price', 'category_encoded')},
               {rnd("avg_order_value / (current_price + 1e-6::double)", 4)} as price_ratio
        from samples join user_features using (user_id) join product_features using (product_id)""",
    "experiment_features": f"""
        select product_id, {at(4, 'discount_pct', 'conversion_rate')}, treated,
               {at(4, 'base_price', 'avg_rating', 'margin_score', 'trend_score')}, review_count, is_new_launch, category_encoded
        from exps join product_features using (product_id)""",
    "user_features": f"""
        select {", ".join(USER_OTHERS)}, {at(4, *USER_DOUBLES, "avg_price_paid")}, purchase_count_30d, segment_encoded
        from user_features""",
    "demand_with_product": f"""
        select product_id, day_no::int as day_no, demand_7d, {at(4, 'trend_score', 'avg_rating', 'seasonal_relevance', 'base_price')},
               is_new_launch, category_encoded
        from training_days join product_features using (product_id)""",
    "user_candidate_pairs": ("select user_id, product_id from walked join catalogue using (product_index)", POOL),
    "discount_grid": f"select product_id, {rnd('discount', 6)} as discount from grid",
    "similar_products": (
        """select product_id, place::int as place, similar_id, similarity
           from (select a.product_id, b.product_id as similar_id, s.similarity,
                        row_number() over (partition by a.product_id order by s.similarity desc, b.product_id) as place
                 from traits a join traits b on a.cluster = b.cluster and a.product_id <> b.product_id
                 join likeness s on s.same_category = (a.category = b.category) and s.apart = abs(a.tier - b.tier)
                 where s.similarity > 0.5::double) where place <= 5""",
        {
            "traits": f"select product_id, style_cluster as cluster, category, {tier('current_price')} as tier from products",
            "likeness": f"""
                select same_category, apart, {rnd("0.5::double + 0.3::double * same_category::int + 0.2::double * (1 - apart / 5.0::double)", 4)} as similarity
                from (values (true), (false)) c(same_category), range(0, 5) t(apart)""",
        },
    ),
    "similar_products_loose": (
        f"""select product_id, place::int as place, similar_id, similarity
           from (select product_id, similar_id, similarity,
                        row_number() over (partition by product_id order by similarity desc, similar_id) as place
                 from (select a.product_id, b.product_id as similar_id, {similarity('a', 'b')} as similarity
                       from traits a join traits b on a.product_id <> b.product_id and (a.cluster = b.cluster or a.category = b.category))
                 where similarity > 0.3::double) where place <= 5""",
        {"traits": f"select product_id, style_cluster as cluster, category, {tier('current_price')} as tier from products"},
    ),
    "unknown_users": "select c_custkey as request_id, c_custkey as user_id from customer where c_custkey not in (select user_id from web)",
    "known_users": "select c_custkey as request_id, c_custkey as user_id from customer where c_custkey in (select user_id from web)",
    "preset_join": """
        select request_id, weight_preset, p.preset, propensity, inventory, margin, trend, demand_spike_weight, diversity
        from requests r join presets p on p.preset =
            (case when r.weight_preset in (select preset from presets) then r.weight_preset else 'balanced' end)""",
    "product_score_join": f"""
        select product_id, {at(6, "inventory_pressure")}, {rnd("coalesce(demand_spike, 0.5)", 6)} as demand_spike
        from products left join pressure using (product_id)
        left join spikes using (product_id)""",
    # Aggregations
    "purchase_count_30d": "select user_id, purchase_count_30d from history where purchase_count_30d > 0",
    "avg_price_paid": f"select user_id, {at(4, 'avg_price_paid')} from history",
    "last_viewed": """
        select product_id as last_viewed_product, user_id, ts as last_viewed_at, category as last_viewed_category
        from (select * from web where event_type = 'view'
              qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) left join products using (product_id)""",
    "daily_demand": "select product_id, strftime(sale_day, '%Y-%m-%d') as sale_day, daily_demand from daily",
    "demand_baseline": f"select product_id, {at(6, 'baseline')}, max_target, n_samples from baseline",
    "auc": (
        f"""select {rnd("sum(pos * (coalesce(below, 0) + neg / 2)) / (sum(pos) * sum(neg))", 6)} as auc,
            sum(pos)::bigint as n_positive, sum(neg)::bigint as n_negative
            from (select *, sum(neg) over (order by score rows between unbounded preceding and 1 preceding) as below from by_score)""",
        {
            "by_score": """
                select l_extendedprice * (1 - l_discount) as score,
                       count(*) filter (where l_returnflag = 'R')::double as pos, count(*) filter (where l_returnflag <> 'R')::double as neg
                from lineitem group by 1""",
        },
    ),
    "regression_metrics": f"""
        select {rnd("avg(pow(target_demand_7d - demand_7d, 2))", 6)} as mse, {rnd("sqrt(avg(pow(target_demand_7d - demand_7d, 2)))", 6)} as rmse,
               {rnd("avg(abs(target_demand_7d - demand_7d))", 6)} as mae, count(*) as n_rows from training_days""",
    "class_counts": f"""
        select case when {hash_number("event_id::varchar")} % 100 < 80 then 'train' else 'val' end as split,
               count(*) filter (where label = 1) as positives, count(*) filter (where label = 0) as negatives, count(*) as n_rows
        from samples group by 1""",
    "high_pressure_count": "select count(*) filter (where inventory_pressure > 0.65::double) as n_high_pressure, count(*) as n_products from pressure",
    "badge_count": (
        "select user_id, count(*) filter (where inventory_pressure >= 0.65::double) as n_badges, count(*) as n_products from ranked group by 1",
        ranking(asked(), 20),
    ),
    "store_counts": "select 'users' as store, count(*) as n_rows from customer union all select 'products', count(*) from part",
    "variant_distribution": (
        "select variant, count(*) as n_users from assigned group by 1",
        {
            "assigned": f"""
                select case when b < 40 then 'balanced' when b < 60 then 'lenskart' when b < 80 then 'dyson' else 'amazon' end as variant
                from (select {hash_number("'ranking_weights:' || c_custkey::varchar")} % 100 as b from customer)""",
        },
    ),
    "category_proportions": (f"select feature, value, n, {at(6, 'share')} from text_shares", DRIFT),
    "column_stats": (f"select feature, {at(3, 'mean', 'std')}, n_values from user_stats", DRIFT),
    "quantile_edges": (
        f"select feature, edge_no::int as edge_no, {rnd('edges[edge_no + 1]', 4)} as edge from (select *, unnest(range(0, len(edges))) as edge_no from edge_lists)",
        DRIFT,
    ),
    "histogram": (f"select feature, bin_no, {at(4, 'low', 'high')}, n, {at(4, 'share')} from bins", DRIFT),
    "best_run": (
        f"{best('mean_discount', 'max')} union all {best('mean_quantity', 'min', 'ship_year >= 1998')}",
        RUNS,
    ),
    # Windows
    "rolling_demand": "select product_id, day_no::int as day_no, demand_7d, demand_14d, demand_30d from rolling",
    "prev_week_demand": "select product_id, day_no::int as day_no, previous_7d from rolling",
    "next_7_target": "select product_id, day_no::int as day_no, target_demand_7d from rolling",
    "demand_training_set": f"""
        select product_id, strftime(sale_day, '%Y-%m-%d') as sale_day, demand_7d, demand_14d, demand_30d,
               {at(4, "velocity", "trend_score", "avg_rating", "seasonal_relevance", "base_price")},
               day_of_week, month, is_weekend, is_new_launch, category_encoded, target_demand_7d
        from training_set""",
    "latest_demand_features": f"select product_id, {at(4, *fixed.DEMAND_COLUMNS)} from latest",
    "rank_products": (
        "select user_id, product_id, score, row_number() over (partition by user_id order by score desc, product_id)::int as rank from scored",
        POOL,
    ),
    "argmax_discount": "select * from best",
    # Top k, unions, samples
    "topk_per_user": (
        """select user_id, product_id, score, rank from
           (select *, row_number() over (partition by user_id order by score desc, product_id)::int as rank from scored) where rank <= 10""",
        POOL,
    ),
    "cold_start": (
        f"""select user_id, rank::int as rank, product_id, {rnd("score", 4)} as pick_score, {rnd("score", 4)} as final_score,
            0.5::double as propensity_score, {at(4, "inventory_pressure", "margin_score", "trend_score", "demand_spike")},
            inventory_pressure >= 0.65::double as should_show_sale_badge, {urgency("inventory_pressure")} as urgency_label,
            0.0::double as optimal_discount_pct, category, brand, {rnd("current_price", 2)} as current_price,
            {rnd("base_price", 2)} as base_price, {at(4, "avg_rating")}, 'cold_start' as weights_used,
            (select count(*) from part) as total_candidates
            from (select c_custkey as user_id from customer where c_custkey not in (select user_id from web)) cross join listed""",
        {
            "listed": """
                select *, row_number() over (order by score desc, product_id) as rank
                from (select *, 0.5::double * trend_score + 0.3::double * margin_score + 0.2::double * avg_rating / 5.0::double as score
                      from catalogue) order by score desc, product_id limit 20""",
        },
    ),
    "training_union": "select event_id, user_id, product_id, label from samples",
    "negative_sample": """
        select 3::int as ratio, event_id from negatives union all
        select 1::int, event_id from (select * from web where event_type in ('view', 'wishlist')
            qualify row_number() over (order by md5(event_id::varchar), event_id) <= (select count(*) from web where event_type = 'purchase'))""",
    "candidate_sample": (
        "select user_id, product_index from walked",
        {"asked": asked(candidate_pool="10"), "walked": walk("asked")},
    ),
    "train_val_split": f"select event_id, case when {hash_number('event_id::varchar')} % 100 < 80 then 'train' else 'val' end as split from web",
    "sample_users": "select c_custkey as user_id from customer order by md5(c_custkey::varchar), c_custkey limit 20",
    # Models in closed form
    "propensity_score": f"""
        select event_id, user_id, product_id, {rnd("coalesce(rate, 0.5)", 6)} as propensity_score
        from web join users using (user_id) join products using (product_id) left join rates using (segment, category)""",
    "elasticity_lines": f"select category, treated, {at(4, 'slope', 'intercept')}, n from arm_lines",
    "predict_uplift": f"select product_id, {at(4, 'discount', 'uplift')} from grid",
    "optimal_discount": "select * from best",
    "inventory_pressure": f"select product_id, {at(6, 'inventory_pressure')} from pressure",
    "predict_demand": f"select product_id, {rnd('greatest(demand_7d, 0)', 6)} as predicted_demand from latest",
    "demand_spike": "select * from spikes",
    # Ranking
    "weighted_score": ("select user_id, product_id, score from scored", POOL),
    "recommend": (f"select {RANKED} from ranked", ranking(asked(), 20)),
    "recommend_stream": (f"select {RANKED} from ranked", ranking(asked(), 20)),
    "nested_response": (f"select {RANKED} from ranked", ranking(asked(), 20)),
    "recommend_whole": (
        f"select {RANKED} from of_segment",
        whole("""select segment as request_id, min(user_id) as user_id, 20 as top_k, 'balanced' as weight_preset
                 from users group by segment""", 20),
    ),
    "recommend_whole_scored": (
        f"select {RANKED} from of_segment",
        whole("""select segment as request_id, min(user_id) as user_id, 20 as top_k, 'balanced' as weight_preset
                 from users group by segment""", 20),
    ),
    "recommend_whole_presets": (
        "select user_id, weight_preset as weights_used, rank, product_id, final_score from of_segment",
        whole("""select segment || ':' || preset as request_id, user_id, 5 as top_k, preset as weight_preset
                 from (select segment, min(user_id) as user_id from users group by segment) cross join presets""", 5),
    ),
    "recommend_plain": (
        f"select {RANKED} from ranked",
        ranking(asked(weight_preset="'clearance'"), 10, diverse=False),
    ),
    "answer_requests": (
        """select request_id, user_id, weight_preset as weights_used, total_candidates,
                  null as reject_reason, least(top_k, total_candidates) as n_products, first_product
           from (select request_id, user_id, any_value(weight_preset) as weight_preset, any_value(top_k) as top_k, count(*) as total_candidates,
                        arg_min(product_id, place) as first_product
                 from (select *, row_number() over (partition by request_id order by score desc, product_id) as place from scored)
                 group by 1, 2)
           union all
           select request_id, user_id, 'cold_start', (select count(*) from part), null, least(top_k, (select count(*) from part)),
                  (select product_id from catalogue order by 0.5::double * trend_score + 0.3::double * margin_score
                                                       + 0.2::double * avg_rating / 5.0::double desc, product_id limit 1)
           from checked where reject_reason is null and user_id not in (select user_id from web)
           union all
           select request_id, user_id, null, null, reject_reason, 0, null from checked where reject_reason is not null""",
        {
            "checked": """
                select request_id, user_id, coalesce(top_k, 20) as top_k, coalesce(candidate_pool, 100) as candidate_pool,
                       coalesce(weight_preset, 'balanced') as weight_preset,
                       case when user_id is null then 'user_id' when top_k not between 1 and 100 then 'top_k'
                            when candidate_pool not between 10 and 500 then 'candidate_pool' end as reject_reason
                from requests""",
            "asked": "select * from checked where reject_reason is null and user_id in (select user_id from web)",
            "walked": walk("asked"),
            "scored": scored("walked"),
        },
    ),
    "score_pair": (
        "select request_id, wanted_user as user_id, wanted_product as product_id, "
        + f"case when known then {rnd(TOTAL, 4)} end as final_score, "
        + ", ".join(
            f"case when known then {rnd(c, 4)} end as {c}"
            for c in ["propensity_score", "inventory_pressure", "margin_score", "trend_score", "demand_spike"]
        )
        + f""", case when known then inventory_pressure >= 0.65::double end as should_show_sale_badge,
            case when known then {urgency("inventory_pressure")} end as urgency_label,
            case when known then optimal_discount_pct end as optimal_discount_pct,
            case when known then expected_uplift end as expected_uplift, weight_preset as weights_used,
            case when not known then 'User or product not found' end as error from pair_scores""",
        {"pair_requests": PAIR_REQUESTS, "pair_scores": PAIR_SCORES},
    ),
    "product_similarity": (
        f"select user_id, product_id, {similarity('a', 'b')} as similarity from traits",
        {
            **POOL,
            "traits": """
                select user_id, product_id, {'cluster': cluster, 'category': category, 'tier': tier} as a, first_value(a) over (
                           partition by user_id order by score desc, product_id) as b
                from scored
                qualify row_number() over (partition by user_id order by score desc, product_id) <= 10""",
        },
    ),
    "diversity_penalty": (
        f"""select a.user_id, a.product_id, a.rank,
            coalesce(max({rnd(f"a.diversity * {similarity('a', 'b')}", 4)}), 0.0::double) as diversity_penalty
            from top a left join top b on a.user_id = b.user_id and b.rank < a.rank group by 1, 2, 3""",
        {**POOL, "top": "select * from (select *, row_number() over (partition by user_id order by score desc, product_id)::int as rank from scored) where rank <= 10"},
    ),
    "mmr_rerank": (
        f"select user_id, rank::int as rank, product_id, raw_score as score, pick_score, {rnd('kept', 6)} as final_score from picks",
        {**POOL, "quarter": "select * replace (0.25::double as diversity) from scored", **mmr("quarter", "user_id", 5)},
    ),
    "sale_badge_report": f"""
        select product_id, inventory_pressure >= 0.65::double as should_show_sale_badge,
               {rnd("inventory_pressure", 4)} as inventory_pressure_score, {urgency("inventory_pressure")} as urgency_label,
               optimal_discount_pct, expected_uplift from catalogue""",
    "presets": (
        """select preset as name, description, coalesce(n_users, 0)::bigint as n_users, signal, weight
           from (unpivot (select preset, description, propensity, inventory, margin, trend,
                          demand_spike_weight as demand_spike, diversity as diversity_lambda from presets)
                 on propensity, inventory, margin, trend, demand_spike, diversity_lambda into name signal value weight)
           left join (select variant, count(*) as n_users from assigned group by 1) on variant = preset""",
        {
            "assigned": f"""
                select case when b < 40 then 'balanced' when b < 60 then 'lenskart' when b < 80 then 'dyson' else 'amazon' end as variant
                from (select {hash_number("'ranking_weights:' || c_custkey::varchar")} % 100 as b from customer)""",
        },
    ),
    "preset_validate": f"""
        select preset as name, n_requests, {rnd("propensity + inventory + margin + trend + demand_spike_weight", 6)} as weight_sum,
               propensity + inventory + margin + trend + demand_spike_weight between 0.95 and 1.05 as is_valid
        from presets join (select case when weight_preset in (select preset from presets) then weight_preset else 'balanced' end as used,
                                  count(*) as n_requests from requests group by 1) on used = preset""",
    "ab_assign": (
        """select user_id, 'ranking_weights' as experiment, bucket, variant,
                  'User ' || user_id::varchar || ' is assigned to the ''' || variant || ''' weight preset' as description
           from (select *, case when bucket < 40 then 'balanced' when bucket < 60 then 'lenskart' when bucket < 80 then 'dyson' else 'amazon' end as variant
                 from buckets)""",
        {"buckets": f"select c_custkey as user_id, {hash_number(chr(39) + 'ranking_weights:' + chr(39) + ' || c_custkey::varchar')} % 100 as bucket from customer"},
    ),
    "preset_comparison": (
        "select user_id, weight_preset as weights_used, rank, product_id, final_score from ranked",
        ranking(EVERY_PRESET, 5),
    ),
    # Drift
    "drift_fit": (
        f"""select feature, 'numeric' as kind, bin_no::varchar as part, {at(4, 'low')}, {at(6, 'share')}, {at(3, 'mean', 'std')}
            from bins join user_stats using (feature)
            union all select feature, 'categorical', value, null, {rnd('share', 6)}, null, null from text_shares""",
        DRIFT,
    ),
    "psi": ("select feature, psi, out_of_range_count from psi_table", TWO),
    "psi_level": ("select feature, level from psi_levels", TWO),
    "drift_check": ("select feature, metric, value, threshold, level from alerts", ALERTS),
    "drift_alert_text": (
        """select *, case level when 'critical' then '🚨' else '⚠️' end || ' [' || upper(level) || '] ' || feature || ': ' || metric
                  || '=' || format('{:.4f}', value) || ' (threshold=' || threshold::varchar || ')' as text from alerts""",
        ALERTS,
    ),
    "drift_windows": (
        f"""select strftime(make_timestamp(week * 604800000000), '%Y-%m-%d') as window_start, feature, {rnd('psi', 6)} as value,
            case when psi >= 0.25::double then 'critical' else 'warning' end as level
            from week_psi where psi >= 0.10::double""",
        WINDOWS,
    ),
    "drift_profile_merged": (
        f"""select feature, bin_no::varchar as part, n::bigint as n, {rnd('low', 4)} as low, {at(3, 'mean', 'std')}
            from merged_bins join (select feature, avg(value) as mean, stddev_samp(value) as std from ref_values group by 1) using (feature)
            union all select feature, value, count(*), null, null, null from ref_texts group by 1, 2""",
        MERGED,
    ),
    "chi_square": (
        f"""select feature, {rnd(rnd("sum(pow(observed + 1e-10::double - (share * size + 1e-10::double), 2) / (share * size + 1e-10::double))", 6), 3)} as statistic,
            count(*) - 1 as dof, (select count(*) from cur_texts c where c.feature = chi_rows.feature)
               - any_value(size)::bigint as unseen_count
            from chi_rows group by 1""",
        TWO,
    ),
    "drift_summary": (
        """select *, 14::int as n_numeric_features, 2::int as n_categorical_features, 0.1::double as psi_warning, 0.25::double as psi_critical
           from (select feature, 'numeric' as kind, len(edges) - 1 as n_parts from edge_lists
                 union all select feature, 'categorical', count(*) from text_shares group by 1)""",
        DRIFT,
    ),
    "score_zscore": (
        f"""select weights_used, {at(4, 'mean')}, {at(4, 'z')},
            case when z > 3 then 'critical' when z > 2 then 'warning' else 'none' end as level
            from (select weight_preset as weights_used, avg(final_score) as mean,
                         abs(avg(final_score) - (select avg(final_score) from ranked where weight_preset = 'balanced'))
                         / ((select stddev_samp(final_score) from ranked where weight_preset = 'balanced') + 1e-10::double) as z
                  from ranked group by 1)""",
        ranking(EVERY_PRESET, 5),
    ),
    # Run log
    "log_weights": (
        """select experiment, run_name, key, value from
           (select experiment, run_name, 'return_flag' as key, l_returnflag as value from run_base
            union all select experiment, run_name, 'ship_year', ship_year::varchar from run_base
            union all select experiment, run_name, 'weight_preset', variant from chosen
            union all select experiment, run_name, 'w_' || signal, weight::varchar from chosen
              join (unpivot (select preset, propensity, inventory, margin, trend, demand_spike_weight as demand_spike, diversity as diversity_lambda from presets)
                    on propensity, inventory, margin, trend, demand_spike, diversity_lambda into name signal value weight) on preset = variant)""",
        {
            **RUNS,
            "chosen": f"""
                select *, case when b < 40 then 'balanced' when b < 60 then 'lenskart' when b < 80 then 'dyson' else 'amazon' end as variant
                from (select *, {hash_number("'ranking_weights:' || run_name")} % 100 as b from run_base)""",
        },
    ),
    "run_summary": (
        f"""select experiment, run_name, epoch(end_time - start_time)::double as seconds, 2::int as n_params,
            (case when ship_year >= 1998 then 3 else 2 end)::int as n_metrics, {rnd("mean_discount", 4)} as mean_discount from run_base""",
        RUNS,
    ),
}


def statements() -> dict[str, str]:
    """Query name to a complete statement."""
    result = {}
    for name, entry in BODIES.items():
        body, parts = (entry, {}) if isinstance(entry, str) else entry
        result[name] = with_clause(body.strip(), parts)
    return result
