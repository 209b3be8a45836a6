"""Drift profiles that add up: a day's summary is merged into the last profile.

A summary holds, for every numeric feature, one row per bucket of nearly equal values: their
number, least and largest value, and first two moments about the bucket's centre.  A bucket's
values differ by the factor ``GROWTH`` at most; zero and either sign have buckets of their
own, so there are some hundred thousand at the very most, whatever the number of rows.  Text features have
a row per value.  Everything in it is a sum, a minimum or a maximum, so summaries of parts,
merged in any order, are the summary of the whole.

Profiles made of a summary take their edges from values that occur: an edge is the least value
of the bucket that holds the quantile, and within the factor ``GROWTH`` of it.  Counts and
shares of the bins are exact for these edges.  NaN is left out, as null is.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine import fixed
from vitrine.operators import drift
from vitrine.operators.features import columns_by_type
from vitrine.sources.staging import stage

GROWTH = 1.002
# Beyond the logarithm of any double in buckets.
OFFSET = 400_000
PARTS = ["feature", "kind", "bucket", "value"]


def bucket_of(value: Column) -> Column:
    steps = F.least(F.greatest(F.ln(F.abs(value)) / math.log(GROWTH), F.lit(-OFFSET + 1.0)), F.lit(OFFSET - 1.0))
    return F.when(value == 0, F.lit(0).cast("bigint")).otherwise(
        F.signum(value).cast("bigint") * (F.floor(steps) + OFFSET)
    )


def centre_of(bucket: Column) -> Column:
    size = F.pow(F.lit(GROWTH), F.abs(bucket) - OFFSET + 0.5)
    return F.when(bucket == 0, 0.0).otherwise(F.signum(bucket.cast("double")) * size)


def summarise(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The summary of a table, or one for each value of the ``by`` columns."""
    by = by or []
    numeric, text = columns_by_type(table.drop(*by))
    parts = [
        F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("number"), F.lit(None).cast("string").alias("value"))
        for n in numeric
    ] + [
        F.struct(F.lit(n).alias("feature"), F.lit(None).cast("double").alias("number"), F.col(n).alias("value"))
        for n in text
    ]
    rows = table.select(*by, F.inline(F.array(*parts))).where(
        F.col("value").isNotNull() | (F.col("number").isNotNull() & ~F.isnan("number"))
    )
    kind = F.when(F.col("number").isNotNull(), "numeric").otherwise("categorical")
    rows = rows.withColumns({"kind": kind, "bucket": bucket_of(F.col("number"))})
    off = F.col("number") - centre_of(F.col("bucket"))
    return rows.groupBy(*by, *PARTS).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("number").alias("low"),
        F.max("number").alias("high"),
        F.sum(off).alias("off"),
        F.sum(off * off).alias("off_squared"),
    )


def merge(*summaries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The summary of all the rows behind the given ones; ``by`` columns not named are merged."""
    every = reduce(DataFrame.unionByName, summaries)
    return every.groupBy(*(by or []), *PARTS).agg(
        *[F.sum(n).alias(n) for n in ("n", "off", "off_squared")],
        F.min("low").alias("low"), F.max("high").alias("high"),
    )


def moments(summary: DataFrame) -> DataFrame:
    """(feature, mean, std, n_values) of the numeric features."""
    per = Window.partitionBy("feature")
    bucket_mean = centre_of(F.col("bucket")) + F.col("off") / F.col("n")
    rows = summary.where("kind = 'numeric'").withColumn("own", bucket_mean)
    rows = rows.withColumn("mean", F.sum(F.col("own") * F.col("n")).over(per) / F.sum("n").over(per))
    away = F.col("own") - F.col("mean")
    inner = F.col("off_squared") - F.col("off") * F.col("off") / F.col("n")
    squares = F.sum(F.greatest(inner, F.lit(0.0)) + F.col("n") * away * away)
    return rows.groupBy("feature").agg(
        F.first("mean").alias("mean"), squares.alias("squares"), F.sum("n").alias("n_values")
    ).select(
        "feature", "mean",
        F.when(F.col("n_values") > 1, F.sqrt(F.col("squares") / (F.col("n_values") - 1))).alias("std"),
        "n_values",
    )


def ranked_edges(summary: DataFrame, bins: int = fixed.DRIFT_BINS) -> DataFrame:
    """(feature, edges) with structs of ``edge`` and ``below``, as ``quantiles.ranked_edges``."""
    order = Window.partitionBy("feature").orderBy("bucket")
    whole = Window.partitionBy("feature")
    rows = summary.where("kind = 'numeric'").select(
        "feature", "low", "high", "n",
        (F.sum("n").over(order) - F.col("n")).alias("below"),
        F.sum("n").over(whole).alias("n_total"),
        F.max("high").over(whole).alias("largest"),
    )
    wanted = F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.floor((F.col("n_total") - 1) * i / bins)
    )
    holds = F.exists(wanted, lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("n")))
    edges = rows.where(holds).select("feature", F.col("low").alias("edge"), "below")
    # The last edge is the largest value; the last bin is closed, so nothing asks what is under it.
    last = rows.groupBy("feature").agg(F.first("largest").alias("edge"), F.first("n_total").alias("below"))
    found = edges.unionByName(last).groupBy("feature", "edge").agg(F.min("below").alias("below"))
    return found.groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("edge", "below"))).alias("edges"))


def profile_of(summary: DataFrame, bins: int = fixed.DRIFT_BINS) -> drift.Profile:
    """The drift profile of all that went into a summary."""
    summary = stage(summary, "summary")
    stats = moments(summary)
    edges = stage(ranked_edges(summary, bins), "summary_edges")
    counts = summary.where("kind = 'categorical'").select("feature", "value", "n")
    share = F.col("n") / F.sum("n").over(Window.partitionBy("feature"))
    names = {
        kind: sorted(r["feature"] for r in summary.where(F.col("kind") == kind).select("feature").distinct().collect())
        for kind in ("numeric", "categorical")
    }  # one row per monitored column
    return drift.Profile(
        stage(drift.quantiles.edge_values(edges).join(F.broadcast(stats), "feature"), "summary_numeric"),
        stage(drift.quantiles.bins_of(edges, stats), "summary_bins"),
        counts.withColumn("share", share),
        names["numeric"],
        names["categorical"],
        bins,
    )
