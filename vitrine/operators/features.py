"""User features from profile and events, filters over events, and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from vitrine import fixed
from vitrine.functions import scalars as S
from vitrine.operators.skew import keyed_join

NEGATIVE_TYPES = ["view", "wishlist"]


def purchases_only(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type") == "purchase")


def negatives_only(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type").isin(NEGATIVE_TYPES))


def latest_time(events: DataFrame) -> Column:
    return events.agg(F.max("ts")).scalar()


def recent_purchases(events: DataFrame, as_of: Column | None = None, days: int = 30) -> DataFrame:
    as_of = latest_time(events) if as_of is None else as_of
    return purchases_only(events).filter(F.col("ts") >= as_of - F.expr(f"interval {days} days"))


def purchase_counts(events: DataFrame, as_of: Column | None = None) -> DataFrame:
    return recent_purchases(events, as_of).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("purchase_count_30d")
    )


def average_prices(events: DataFrame) -> DataFrame:
    return purchases_only(events).groupBy("user_id").agg(
        F.avg("price_paid").alias("avg_price_paid")
    )


def last_viewed(events: DataFrame) -> DataFrame:
    """Product each user viewed last; of equal times the higher event id."""
    return (
        events.filter(F.col("event_type") == "view")
        .groupBy("user_id")
        .agg(
            F.max_by("product_id", F.struct("ts", "event_id")).alias("last_viewed_product"),
            F.max("ts").alias("last_viewed_at"),
        )
    )


def last_viewed_category(events: DataFrame, products: DataFrame) -> DataFrame:
    catalogue = products.select(F.col("product_id").alias("last_viewed_product"), "category")
    viewed = keyed_join(last_viewed(events), catalogue, "last_viewed_product", "left")
    return viewed.withColumnRenamed("category", "last_viewed_category")


def user_history(events: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Recent purchase count and mean price paid, both from one pass over the purchases."""
    as_of = latest_time(events) if as_of is None else as_of
    recent = F.col("ts") >= as_of - F.expr("interval 30 days")
    return purchases_only(events).groupBy("user_id").agg(
        F.count_if(recent).alias("purchase_count_30d"),
        F.avg("price_paid").alias("avg_price_paid"),
    )


def user_features(
    users: DataFrame, events: DataFrame, as_of: Column | None = None
) -> DataFrame:
    """Profile plus history.  Events are aggregated by user before the join."""
    return (
        users.join(user_history(events, as_of), "user_id", "left")
        .withColumns(
            {
                "purchase_count_30d": F.coalesce("purchase_count_30d", F.lit(0)).cast("bigint"),
                "avg_price_paid": F.coalesce("avg_price_paid", "avg_order_value"),
                "segment_encoded": S.segment_code(F.col("segment")),
            }
        )
    )


def product_features(products: DataFrame, category_codes: dict[str, int]) -> DataFrame:
    return products.withColumn("category_encoded", S.encode(F.col("category"), category_codes))


def columns_by_type(table: DataFrame) -> tuple[list[str], list[str]]:
    """Names of the numeric and of the text columns."""
    fields = table.schema.fields
    return (
        [field.name for field in fields if isinstance(field.dataType, NumericType)],
        [field.name for field in fields if isinstance(field.dataType, StringType)],
    )


def impute_missing(table: DataFrame) -> DataFrame:
    """Defaults for rows whose product is not in the catalogue."""
    return table.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(value))
            for name, value in fixed.MISSING_PRODUCT.items()
            if name in table.columns
        }
    )


def store_counts(users: DataFrame, products: DataFrame) -> DataFrame:
    counts = [
        table.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("store"), "n_rows")
        for name, table in (("users", users), ("products", products))
    ]
    return counts[0].unionByName(counts[1])


def validate_requests(requests: DataFrame) -> DataFrame:
    """Fill the defaults and name the limit a request breaks, if any."""
    top_k, k_min, k_max = fixed.TOP_K
    pool, pool_min, pool_max = fixed.CANDIDATE_POOL
    filled = requests.withColumns(
        {
            "top_k": F.coalesce("top_k", F.lit(top_k)),
            "candidate_pool": F.coalesce("candidate_pool", F.lit(pool)),
            "weight_preset": F.coalesce("weight_preset", F.lit(fixed.DEFAULT_PRESET)),
            "apply_diversity": F.coalesce("apply_diversity", F.lit(True)),
        }
    )
    reason = (
        F.when(F.col("user_id").isNull(), "user_id")
        .when(~F.col("top_k").between(k_min, k_max), "top_k")
        .when(~F.col("candidate_pool").between(pool_min, pool_max), "candidate_pool")
    )
    return filled.withColumn("reject_reason", reason)
