"""Inventory pressure: features, closed-form score, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import fixed
from vitrine.functions import scalars as S


def feature_columns(category_codes: dict[str, int]) -> dict[str, Column]:
    """The features of a product row, zero where something is missing."""
    initial = F.when(
        F.col("initial_stock").isNotNull(), F.greatest("initial_stock", F.lit(1))
    )
    spare = F.greatest(F.col("current_stock") - F.col("reorder_threshold"), F.lit(0))
    shelf = S.clip(F.col("days_on_shelf") / fixed.SHELF_DAYS, 0.0, 1.0)
    columns = {
        "stock_ratio": F.col("current_stock") / initial,
        "sell_through_rate": F.col("sell_through_rate"),
        "days_on_shelf": F.col("days_on_shelf"),
        "days_normalized": F.when(F.col("days_on_shelf").isNotNull(), shelf),
        "stock_buffer": F.when(
            F.col("current_stock").isNotNull() & F.col("reorder_threshold").isNotNull(),
            spare / initial,
        ),
        "trend_score": F.col("trend_score"),
        "seasonal_relevance": F.col("seasonal_relevance"),
        "margin_score": F.col("margin_score"),
        "category_encoded": S.encode(F.col("category"), category_codes),
    }
    columns["ageing_score"] = columns["days_normalized"] * (1 - F.col("sell_through_rate"))
    return {
        name: F.coalesce(columns[name].cast("double"), F.lit(0.0))
        for name in fixed.INVENTORY_COLUMNS
    }


def inventory_features(products: DataFrame, category_codes: dict[str, int]) -> DataFrame:
    filled = feature_columns(category_codes)
    return products.select("product_id", *[c.alias(name) for name, c in filled.items()])


def pressure(features: dict[str, Column] | None = None) -> Column:
    """Deadstock pressure of features, by default of a row of ``inventory_features``."""
    of = features or {name: F.col(name) for name in fixed.INVENTORY_COLUMNS}
    total = (
        0.35 * of["ageing_score"]
        + 0.30 * (1 - of["sell_through_rate"])
        + 0.20 * of["days_normalized"]
        + 0.10 * (1 - of["trend_score"])
        + 0.05 * (1 - S.clip(of["stock_buffer"], 0.0, 1.0))
    )
    return S.clip(total, 0.0, 1.0)


def with_pressure(products: DataFrame, category_codes: dict[str, int]) -> DataFrame:
    """Products with their pressure as a column: no join."""
    return products.withColumn("inventory_pressure", pressure(feature_columns(category_codes)))


def inventory_pressure(products: DataFrame, category_codes: dict[str, int]) -> DataFrame:
    return inventory_features(products, category_codes).select(
        "product_id", pressure().alias("inventory_pressure")
    )


def with_labels(scored: DataFrame) -> DataFrame:
    score = F.col("inventory_pressure")
    return scored.withColumns(
        {"should_show_sale_badge": S.sale_badge(score), "urgency_label": S.urgency_label(score)}
    )
