"""Model metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import fixed
from vitrine.operators.ordering import running_totals


def auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve, ties counting half.

    Rows with one score are counted together, then each score's positives meet the
    negatives below it through running totals over ordered ranges.
    """
    grouped = scored.groupBy(score).agg(
        F.sum(F.col(label).cast("bigint")).alias("positives"),
        F.sum(1 - F.col(label).cast("bigint")).alias("negatives"),
    )
    totals = running_totals(grouped, [score], ["negatives"])
    wins = F.sum(F.col("positives") * (F.col("negatives_before") + F.col("negatives") / 2))
    return totals.agg(
        (wins / F.nullif(F.sum("positives") * F.sum("negatives"), F.lit(0))).alias("auc"),
        F.sum("positives").alias("n_positive"),
        F.sum("negatives").alias("n_negative"),
    )


def regression_metrics(rows: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    error = actual - predicted
    return rows.agg(
        F.avg(error * error).alias("mse"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def class_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("split").agg(
        F.count_if(F.col("label") == 1).alias("positives"),
        F.count_if(F.col("label") == 0).alias("negatives"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def high_pressure_count(scored: DataFrame) -> DataFrame:
    """Products strictly above the badge threshold."""
    return scored.agg(
        F.count_if(F.col("inventory_pressure") > fixed.BADGE_THRESHOLD).alias("n_high_pressure"),
        F.count(F.lit(1)).alias("n_products"),
    )
