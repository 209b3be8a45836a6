"""Purchase propensity: training pairs and the closed-form score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import fixed
from vitrine.functions.vectors import propensity_columns
from vitrine.operators.sampling import training_union
from vitrine.operators.skew import keyed_join
from vitrine.sources.staging import stage


def training_pairs(
    events: DataFrame,
    users: DataFrame,
    products: DataFrame,
    category_codes: dict[str, int],
    ratio: int = 3,
) -> DataFrame:
    """Labelled samples with the training columns; unknown users and products are skipped."""
    samples = training_union(events, ratio).select("event_id", "user_id", "product_id", "label")
    pairs = keyed_join(samples, users, "user_id", sketch=events, unique="event_id")
    pairs = keyed_join(pairs, products, "product_id", sketch=events, unique="event_id")
    columns = propensity_columns(users, category_codes)
    return pairs.select(
        "event_id",
        "user_id",
        "product_id",
        "label",
        *[column.alias(name) for name, column in columns.items()],
    )


def purchase_rates(
    events: DataFrame, users: DataFrame, products: DataFrame, ratio: int = 3
) -> DataFrame:
    """Smoothed purchase rate of each customer segment in each category."""
    samples = training_union(events, ratio).select("event_id", "user_id", "product_id", "label")
    segments, categories = users.select("user_id", "segment"), products.select("product_id", "category")
    pairs = keyed_join(samples, segments, "user_id", sketch=events, unique="event_id")
    pairs = keyed_join(pairs, categories, "product_id", sketch=events, unique="event_id")
    return (
        pairs.groupBy("segment", "category")
        .agg(F.count(F.lit(1)).alias("n_samples"), F.sum("label").alias("n_purchases"))
        .withColumn("rate", (F.col("n_purchases") + 1) / (F.col("n_samples") + 2))
    )


def rates_by_category(rates: DataFrame) -> DataFrame:
    """One row per category with a map from segment to rate.  There are few segments."""
    entries = F.collect_list(F.struct("segment", "rate"))
    return rates.groupBy("category").agg(F.map_from_entries(entries).alias("segment_rates"))


def fit_rates(events: DataFrame, users: DataFrame, products: DataFrame) -> DataFrame:
    """The closed-form model: a staged table of rates by category."""
    return stage(rates_by_category(purchase_rates(events, users, products)), "rates")


def closed_form_propensity(segment: Column, segment_rates: Column) -> Column:
    return F.coalesce(segment_rates[segment], F.lit(fixed.DEFAULT_SCORE))


def highest_rate(segments: list[str], segment_rates: Column) -> Column:
    """The most that ``closed_form_propensity`` gives any of the segments."""
    rates = [closed_form_propensity(F.lit(segment), segment_rates) for segment in segments]
    return F.array_max(F.array(F.lit(0.0), *rates))
