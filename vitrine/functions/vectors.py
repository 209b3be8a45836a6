"""Feature vectors as arrays of doubles, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import fixed
from vitrine.functions.scalars import encode, price_ratio, segment_code


def affinity_columns(users: DataFrame) -> list[str]:
    return [name for name in users.columns if name.startswith("affinity_")]


def doubles(columns: list[Column]) -> Column:
    return F.array(*[column.cast("double") for column in columns])


def user_vector(features: DataFrame) -> Column:
    """Serving vector of a row of ``user_features``: base, segment, history, affinities."""
    names = (
        fixed.USER_BASE
        + ["segment_encoded", "purchase_count_30d", "avg_price_paid"]
        + affinity_columns(features)
    )
    return doubles([F.col(name) for name in names])


def product_vector() -> Column:
    return doubles([F.col(name) for name in fixed.PRODUCT_VECTOR])


def pad_or_trim(vector: Column, length: int) -> Column:
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0), length)), 1, length)


def propensity_columns(users: DataFrame, category_codes: dict[str, int]) -> dict[str, Column]:
    """The training columns, by name, over a row that holds a user and a product."""
    columns = {name: F.col(name) for name in fixed.USER_BASE + affinity_columns(users)}
    columns["segment_encoded"] = segment_code(F.col("segment"))
    columns.update({name: F.col(name) for name in fixed.PRODUCT_TRAINING})
    columns["category_encoded"] = encode(F.col("category"), category_codes)
    columns["price_ratio"] = price_ratio(F.col("avg_order_value"), F.col("current_price"))
    return {name: column.cast("double") for name, column in columns.items()}
