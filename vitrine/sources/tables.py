"""The users, products, events and experiments tables, derived from the warehouse tables.

Nothing is rounded here except where a column is defined by a number of places.
``as_of`` is the newest timestamp in the data, read by a scalar subquery, so no
result depends on the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine import fixed
from vitrine.functions import scalars as S
from vitrine.operators.skew import keyed_join

SEGMENT_OF = {
    "BUILDING": "VIP",
    "AUTOMOBILE": "Regular",
    "MACHINERY": "Regular",
    "HOUSEHOLD": "New",
    "FURNITURE": "Lapsed",
}

WEB_EVENT_TYPES = {
    "purchase": "purchase",
    "view": "view",
    "click": "add_to_cart",
    "signup": "wishlist",
}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def newest(table: DataFrame, column: str) -> Column:
    """The latest value of a column, as a scalar subquery."""
    return table.agg(F.max(column)).scalar()


def relabel(value: Column, names: dict[str, str], other: Column) -> Column:
    result = other
    for key, name in names.items():
        result = F.when(value == key, name).otherwise(result)
    return result


def days_before(moment: Column, day: Column) -> Column:
    return F.datediff(moment.cast("date"), day.cast("date"))


def segment() -> Column:
    return relabel(F.col("c_mktsegment"), SEGMENT_OF, F.lit("New"))


def users(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer: order history, web activity and category affinities."""
    customer, orders, lineitem, part, events = (
        read(spark, folder, name) for name in ("customer", "orders", "lineitem", "part", "events")
    )
    as_of = newest(orders, "o_orderdate")
    web_as_of = newest(events, "ts")

    history = orders.groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.max("o_orderdate").alias("last_order"),
        F.min("o_orderdate").alias("first_order"),
        F.count_if(F.col("o_orderdate") >= as_of - F.expr("interval 90 days")).alias("orders_90d"),
        F.avg("o_totalprice").alias("avg_order_value"),
        F.sum("o_totalprice").alias("lifetime_spend"),
    )

    lines = lineitem.select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_partkey").alias("p_partkey"),
        (F.col("l_discount") >= fixed.TREATED_FROM).cast("int").alias("discounted"),
    )
    parts = lineitem.select(F.col("l_partkey").alias("p_partkey"))
    lines = keyed_join(lines, part.select("p_partkey", "p_type"), "p_partkey", sketch=parts)
    kinds = list(fixed.PART_TYPE_CODES)
    per_order = lines.groupBy("o_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("discounted").alias("n_discounted"),
        *[F.count_if(F.col("p_type") == kind).alias(f"n_{kind.lower()}") for kind in kinds],
    )
    counted = [name for name in per_order.columns if name.startswith("n_")]
    # One row on either side for each order: no key can be hot.
    tastes = (
        per_order.join(orders.select("o_orderkey", "o_custkey"), "o_orderkey")
        .groupBy(F.col("o_custkey").alias("user_id"))
        .agg(*[F.sum(name).alias(name) for name in counted])
    )

    week = F.col("ts") >= web_as_of - F.expr("interval 7 days")
    web = events.groupBy("user_id").agg(
        F.count_distinct(F.when(week, F.to_date("ts"))).alias("sessions_7d"),
        F.count_if(F.col("event_type") == "purchase").alias("n_bought"),
        F.count_if(F.col("event_type") == "click").alias("n_clicked"),
    )

    wide = (
        customer.select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
        .join(history, "user_id", "left")
        .join(tastes, "user_id", "left")
        .join(web, "user_id", "left")
    )
    zero = F.lit(0)
    n_lines = F.greatest(F.coalesce("n_lines", zero), F.lit(1))
    favourite = F.greatest(
        *[
            F.struct(
                F.coalesce(f"n_{kind.lower()}", zero).alias("n"),
                F.lit(-place).alias("place"),
                F.lit(kind).alias("kind"),
            )
            for place, kind in enumerate(sorted(kinds))
        ]
    )
    bought, clicked = F.col("n_bought"), F.col("n_clicked")
    abandoned = 1 - bought / F.greatest(clicked + bought, F.lit(1))
    wide = wide.withColumn(
        "preferred_category", F.when(F.col("n_lines") > 0, favourite["kind"]).otherwise("")
    )
    preferred = F.col("preferred_category")
    return wide.select(
        "user_id",
        F.coalesce(days_before(as_of, F.col("last_order")), zero).alias("recency_days"),
        F.coalesce("orders_90d", zero).cast("bigint").alias("purchase_freq_90d"),
        F.coalesce("avg_order_value", F.lit(0.0)).alias("avg_order_value"),
        F.coalesce("lifetime_spend", F.lit(0.0)).alias("lifetime_spend"),
        F.coalesce(days_before(as_of, F.col("first_order")), zero).alias("account_age_days"),
        (F.coalesce("n_discounted", zero) / n_lines).alias("price_sensitivity"),
        F.coalesce("sessions_7d", zero).cast("bigint").alias("sessions_7d"),
        F.coalesce(abandoned, F.lit(0.0)).alias("cart_abandon_rate"),
        segment().alias("segment"),
        "preferred_category",
        *[
            S.boosted_affinity(
                F.coalesce(f"n_{kind.lower()}", zero) / n_lines, kind, preferred
            ).alias(f"affinity_{kind.lower()}")
            for kind in kinds
        ],
    )


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, segment) of ``users``, for work that needs no history: no join."""
    return read(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), segment().alias("segment")
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    """One row per part.  Lines are aggregated by part before they meet the catalogue."""
    part, lineitem = (read(spark, folder, name) for name in ("part", "lineitem"))
    as_of = newest(lineitem, "l_shipdate")
    open_quantity = F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0)
    sales = lineitem.groupBy(F.col("l_partkey").alias("product_id")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("l_quantity").alias("quantity"),
        F.sum(open_quantity).alias("open_quantity"),
        F.avg("l_discount").alias("discount"),
        F.min("l_shipdate").alias("first_shipped"),
        F.max("l_shipdate").alias("last_shipped"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
        F.count_if(F.col("l_shipdate") >= as_of - F.expr("interval 365 days")).alias("n_year"),
        F.count_if(F.month("l_shipdate") == F.month(as_of)).alias("n_month"),
    )
    zero = F.lit(0)
    lines = F.greatest(F.coalesce("n", zero), F.lit(1))

    def share(name: str) -> Column:
        return F.coalesce(name, zero) / lines

    catalogue = part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        (F.col("p_retailprice") * F.col("p_size") / 50).alias("base_price"),
        F.col("p_size").alias("reorder_threshold"),
        (0.3 + 0.03 * F.pmod("p_partkey", F.lit(10))).alias("cost_share"),
        F.pmod("p_partkey", F.lit(20)).cast("int").alias("style_cluster"),
    )
    table = catalogue.join(sales, "product_id", "left").select(
        "product_id",
        "category",
        "brand",
        "base_price",
        (F.col("base_price") * (1 - F.coalesce("discount", F.lit(0.0)))).alias("current_price"),
        (F.col("base_price") * F.col("cost_share")).alias("cost_price"),
        F.coalesce("open_quantity", F.lit(0.0)).cast("int").alias("current_stock"),
        F.coalesce("quantity", F.lit(0.0)).cast("int").alias("initial_stock"),
        "reorder_threshold",
        F.coalesce(days_before(as_of, F.col("last_shipped")), zero).alias("days_on_shelf"),
        (5 - 2.5 * share("n_returned")).alias("avg_rating"),
        F.coalesce("n", zero).cast("bigint").alias("review_count"),
        F.least(F.lit(1.0), 4 * share("n_year")).alias("trend_score"),
        F.coalesce((F.col("first_shipped") >= F.lit("1995-07-01").cast("date")).cast("int"), zero)
        .alias("is_new_launch"),
        "style_cluster",
        F.least(F.lit(1.0), 5 * share("n_month")).alias("seasonal_relevance"),
    )
    return derived_columns(table)


def derived_columns(table: DataFrame) -> DataFrame:
    """Sell-through rate and margin score of a product table."""
    return table.withColumns(
        {
            "sell_through_rate": S.sell_through_rate(
                F.col("initial_stock"), F.col("current_stock")
            ),
            "margin_score": S.margin_score(F.col("current_price"), F.col("cost_price")),
        }
    )


EVENT_COLUMNS = [
    "event_id", "user_id", "product_id", "ts", "event_type", "price_paid", "quantity", "source",
]


def lines_as_purchases(lineitem: DataFrame) -> DataFrame:
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lineitem.select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_shipdate").alias("ts"),
        (paid / F.greatest("l_quantity", F.lit(1.0))).alias("price_paid"),
        F.col("l_quantity").cast("int").alias("quantity"),
    )


def ship_events(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases: every line of every order, on the day it shipped."""
    orders, lineitem = (read(spark, folder, name) for name in ("orders", "lineitem"))
    lines = lines_as_purchases(lineitem)
    # An order has a handful of lines, so its key needs no guard.
    return lines.join(orders.select("o_orderkey", "o_custkey"), "o_orderkey").select(
        F.lit(None).cast("bigint").alias("event_id"),
        F.col("o_custkey").alias("user_id"),
        "product_id",
        "ts",
        F.lit("purchase").alias("event_type"),
        "price_paid",
        "quantity",
        F.lit("ship").alias("source"),
    )


def shipments(spark: SparkSession, folder: str) -> DataFrame:
    """The product side of ``ship_events``, for work that needs no user: no join."""
    return lines_as_purchases(read(spark, folder, "lineitem")).withColumn(
        "event_type", F.lit("purchase")
    )


def web_events(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks, views, purchases and signups of the event log; errors are not events."""
    kind = relabel(F.col("event_type"), WEB_EVENT_TYPES, F.lit(None).cast("string"))
    return (
        read(spark, folder, "events")
        .filter(F.col("event_type").isin(*WEB_EVENT_TYPES))
        .select(
            "event_id",
            "user_id",
            F.get_json_object("props", "$.k").cast("bigint").alias("product_id"),
            "ts",
            kind.alias("event_type"),
            F.col("value").alias("price_paid"),
            F.lit(1).alias("quantity"),
            F.lit("web").alias("source"),
        )
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    return ship_events(spark, folder).unionByName(web_events(spark, folder))


def experiments(spark: SparkSession, folder: str) -> DataFrame:
    """One price experiment per line."""
    return read(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("product_id"),
        F.col("l_discount").alias("discount_pct"),
        (F.col("l_quantity") / 500 + 0.55 * F.col("l_discount")).alias("conversion_rate"),
    )


def load_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        "users": users(spark, folder),
        "products": products(spark, folder),
        "events": events(spark, folder),
        "experiments": experiments(spark, folder),
    }


# What a request may ask for, by order priority.
REQUEST_PRESETS = {
    "1-URGENT": "clearance",
    "2-HIGH": "amazon",
    "3-MEDIUM": "balanced",
    "4-NOT SPECIFIED": "unlisted",
    "5-LOW": "dyson",
}


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """One recommendation request per order, some outside the limits or for an unknown preset."""
    return read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_custkey").alias("user_id"),
        F.floor(F.col("o_totalprice") / 4000).cast("int").alias("top_k"),
        F.floor(F.col("o_totalprice") / 900).cast("int").alias("candidate_pool"),
        relabel(F.col("o_orderpriority"), REQUEST_PRESETS, F.lit(None).cast("string"))
        .alias("weight_preset"),
        (F.col("o_orderstatus") == "O").alias("apply_diversity"),
    )
