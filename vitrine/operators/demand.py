"""Seven-day demand: daily counts, rolling windows over sale days, spike scores.

A day with no sale has no row, so the windows count sale days, not calendar days.  After
the daily count a product has at most one row per day, which bounds every window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine import fixed
from vitrine.functions import scalars as S
from vitrine.operators.features import impute_missing, product_features, purchases_only

HORIZON = 7
PRODUCT_COLUMNS = [
    "trend_score", "avg_rating", "seasonal_relevance", "is_new_launch", "base_price",
    "category_encoded",
]


def daily_demand(events: DataFrame) -> DataFrame:
    """Events per product and day.  The quantity bought does not count."""
    return (
        purchases_only(events)
        .groupBy("product_id", F.to_date("ts").alias("sale_day"))
        .agg(F.count(F.lit(1)).alias("daily_demand"))
    )


def rolling_demand(daily: DataFrame) -> DataFrame:
    """Sums over the sale days before each one, and over the next seven with it."""
    days = Window.partitionBy("product_id").orderBy("sale_day")

    def total(first: int, last: int) -> Column:
        return F.coalesce(F.sum("daily_demand").over(days.rowsBetween(first, last)), F.lit(0))

    ahead = days.rowsBetween(0, HORIZON - 1)
    return daily.withColumns(
        {
            "day_no": F.row_number().over(days),
            "demand_7d": total(-7, -1),
            "demand_14d": total(-14, -1),
            "demand_30d": total(-30, -1),
            "previous_7d": total(-14, -8),
            "target_demand_7d": F.when(
                F.count(F.lit(1)).over(ahead) == HORIZON, F.sum("daily_demand").over(ahead)
            ),
        }
    )


def training_days(daily: DataFrame) -> DataFrame:
    """Sale days with 14 days of history and a full week ahead."""
    return rolling_demand(daily).filter(
        (F.col("day_no") > fixed.DEMAND_HISTORY_ROWS) & F.col("target_demand_7d").isNotNull()
    )


def with_product(
    rows: DataFrame, products: DataFrame, category_codes: dict[str, int]
) -> DataFrame:
    catalogue = product_features(products, category_codes).select("product_id", *PRODUCT_COLUMNS)
    return impute_missing(rows.join(catalogue, "product_id", "left"))


def training_set(
    daily: DataFrame, products: DataFrame, category_codes: dict[str, int]
) -> DataFrame:
    rows = training_days(daily).withColumns(
        {
            "velocity": S.velocity(F.col("demand_7d"), F.col("previous_7d")),
            **S.time_features(F.col("sale_day")),
        }
    )
    return with_product(rows, products, category_codes).select(
        "product_id", "sale_day", *fixed.DEMAND_COLUMNS, "target_demand_7d"
    )


def demand_baseline(daily: DataFrame) -> DataFrame:
    """Mean past-week demand of each product's training days, and the highest target."""
    return (
        training_days(daily)
        .groupBy("product_id")
        .agg(
            F.avg("demand_7d").alias("baseline"),
            F.max("target_demand_7d").alias("max_target"),
            F.count(F.lit(1)).alias("n_samples"),
        )
    )


def latest_features(
    daily: DataFrame,
    products: DataFrame,
    category_codes: dict[str, int],
    as_of: Column | None = None,
) -> DataFrame:
    """Newest demand vector of every product; all zeros for one that never sold."""
    as_of = daily.agg(F.max("sale_day")).scalar() if as_of is None else as_of
    newest_first = Window.partitionBy("product_id").orderBy(F.desc("sale_day"))
    tail = daily.withColumn("r", F.row_number().over(newest_first)).filter(F.col("r") <= 30)

    def last(first: int, to: int) -> Column:
        return F.sum(F.when(F.col("r").between(first, to), F.col("daily_demand")).otherwise(0))

    sums = tail.groupBy("product_id").agg(
        last(1, 7).alias("demand_7d"),
        last(1, 14).alias("demand_14d"),
        last(1, 30).alias("demand_30d"),
        F.when(F.count(F.lit(1)) >= 14, last(8, 14)).otherwise(last(1, 7)).alias("previous_7d"),
    )
    sums = sums.withColumns(
        {
            "velocity": S.velocity(F.col("demand_7d"), F.col("previous_7d")),
            **S.time_features(as_of.cast("date")),
        }
    )
    rows = product_features(products, category_codes).join(sums, "product_id", "left")
    sold = F.col("demand_7d").isNotNull()
    return rows.select(
        "product_id",
        *[
            F.when(sold, F.col(name).cast("double")).otherwise(0.0).alias(name)
            for name in fixed.DEMAND_COLUMNS
        ],
    )


def outlook(daily: DataFrame) -> DataFrame:
    """(product_id, predicted_demand, baseline) of every product that sold: the closed form of
    ``latest_features`` beside the baseline of ``demand_baseline``, from one order of the days."""
    days = Window.partitionBy("product_id").orderBy("sale_day")

    def total(first: int, last: int) -> Column:
        return F.sum("daily_demand").over(days.rowsBetween(first, last))

    placed = daily.withColumns(
        {
            "day_no": F.row_number().over(days),
            "before": total(-7, -1),
            "last_week": total(-6, 0),
            "ahead": F.count(F.lit(1)).over(days.rowsBetween(0, HORIZON - 1)),
        }
    )
    trained = (F.col("day_no") > fixed.DEMAND_HISTORY_ROWS) & (F.col("ahead") == HORIZON)
    # The days are in order within a product already: its newest is the one with none after it.
    return placed.groupBy("product_id").agg(
        F.max(F.when(F.col("ahead") == 1, F.col("last_week"))).cast("double").alias("predicted_demand"),
        F.avg(F.when(trained, F.col("before"))).alias("baseline"),
    )


def predict_closed_form(latest: DataFrame) -> DataFrame:
    """Expect the coming week to repeat the last one."""
    return latest.select(
        "product_id", F.greatest("demand_7d", F.lit(0.0)).alias("predicted_demand")
    )


def spike_score(predicted: Column, baseline: Column) -> Column:
    usable = F.when(F.coalesce(baseline, F.lit(0.0)) == 0, 1.0).otherwise(baseline)
    return S.rnd(F.least(F.lit(1.0), predicted / (usable * fixed.SPIKE_FACTOR)), 4)


def closed_form_spikes(daily: DataFrame, products: DataFrame) -> DataFrame:
    """``demand_spikes`` of the closed form: the daily table is shuffled once."""
    predicted = F.coalesce("predicted_demand", F.lit(0.0))
    return products.select("product_id").join(outlook(daily), "product_id", "left").select(
        "product_id", spike_score(predicted, F.col("baseline")).alias("demand_spike")
    )


def demand_spikes(
    predicted: DataFrame, baseline: DataFrame, products: DataFrame, fallback: bool = False
) -> DataFrame:
    """Spike per product.  With ``fallback`` the trend score stands in for it, which is for
    callers whose model could not be trained."""
    spike = spike_score(F.col("predicted_demand"), F.col("baseline"))
    return (
        predicted.join(baseline.select("product_id", "baseline"), "product_id", "left")
        .join(products.select("product_id", "trend_score"), "product_id")
        .select(
            "product_id",
            (F.col("trend_score") if fallback else spike).alias("demand_spike"),
        )
    )
