"""Drift of a current table against a reference: PSI, chi-square and z-score.

All numeric columns are handled together as (feature, value) rows, and so are all text
columns, so the number of jobs does not grow with the number of columns.  A profile has
a few rows per feature and is what later checks are made against.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from vitrine import fixed
from vitrine.functions import scalars as S
from vitrine.operators import quantiles
from vitrine.operators.features import columns_by_type
from vitrine.sources.staging import stage, together


def long_form(table: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """(feature, value) rows without nulls."""
    typed = table.select(*[F.col(name).cast(kind).alias(name) for name in columns])
    return typed.unpivot([], columns, "feature", "value").filter(F.col("value").isNotNull())


def numeric_values(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return long_form(table, columns or columns_by_type(table)[0], "double")


def category_values(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return long_form(table, columns or columns_by_type(table)[1], "string")


def column_stats(values: DataFrame) -> DataFrame:
    return values.groupBy("feature").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.count(F.lit(1)).alias("n_values"),
    )


def quantile_edges(values: DataFrame, bins: int = fixed.DRIFT_BINS) -> DataFrame:
    """Exact quantile edges per feature, linearly interpolated, without duplicates."""
    sketches = stage(quantiles.sketched(values, bins), "sketches")
    return quantiles.edge_values(quantiles.ranked_edges(values, sketches, bins))


def approximate_edges(values: DataFrame, bins: int = fixed.DRIFT_BINS) -> DataFrame:
    """Quantile edges from a mergeable sketch: one pass and no shuffle of the values."""
    parts = [i / bins for i in range(bins + 1)]
    edges = F.percentile_approx("value", parts, 100_000)
    return values.groupBy("feature").agg(F.array_distinct(edges).alias("edges"))


def bin_of(value: Column, edges: Column, most: int) -> Column:
    """Bin 1..n of a value, the last bin closed on the right; 0 when out of range.

    A single edge makes no bin: its own value gets null.  With at most ``most`` edges the
    edges passed are counted one by one, which unlike an array function is compiled.
    """
    last = F.size(edges) - 1
    outside = ~value.between(F.element_at(edges, 1), F.element_at(edges, -1))
    passed = F.lit(0)
    for place in range(most):
        passed = passed + F.when(value >= F.get(edges, F.lit(place)), 1).otherwise(0)
    return F.when(outside, 0).when(last > 0, F.least(passed, last))


def binned(values: DataFrame, edges: DataFrame, bins: int) -> DataFrame:
    # One row per monitored column.
    return values.join(F.broadcast(edges), "feature").withColumn(
        "bin_no", bin_of(F.col("value"), F.col("edges"), bins + 1)
    )


def histogram(
    values: DataFrame, edges: DataFrame, bins: int = fixed.DRIFT_BINS
) -> DataFrame:
    """Counts and shares per feature and bin, empty bins included."""
    counts = (
        binned(values, edges, bins)
        .filter(F.col("bin_no") > 0)
        .groupBy("feature", "bin_no")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    last = F.size("edges") - 1
    every = edges.filter(last > 0).select(
        "feature",
        F.explode(F.sequence(F.lit(1), last)).alias("bin_no"),
        "edges",
    )
    bins = every.select(
        "feature",
        "bin_no",
        F.element_at("edges", F.col("bin_no")).alias("low"),
        F.element_at("edges", F.col("bin_no") + 1).alias("high"),
    )
    per_feature = Window.partitionBy("feature")
    n = F.coalesce("n", F.lit(0))
    return bins.join(counts, ["feature", "bin_no"], "left").select(
        "feature",
        "bin_no",
        "low",
        "high",
        n.alias("n"),
        (n / F.greatest(F.sum(n).over(per_feature), F.lit(1))).alias("share"),
    )


def category_shares(values: DataFrame) -> DataFrame:
    """Share of each value per feature, nulls left out."""
    counts = values.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    sizes = values.groupBy("feature").agg(F.count(F.lit(1)).alias("size"))
    return counts.join(F.broadcast(sizes), "feature").select(
        "feature", "value", "n", (F.col("n") / F.col("size")).alias("share")
    )


@dataclass
class Profile:
    """A fitted reference, staged: ``numeric`` has a row per feature, ``bins`` a row per
    bin, ``shares`` a row per category."""

    numeric: DataFrame
    bins: DataFrame
    shares: DataFrame
    numeric_names: list[str]
    category_names: list[str]
    n_bins: int = fixed.DRIFT_BINS


def fit(table: DataFrame, bins: int = fixed.DRIFT_BINS, exact: bool = True) -> Profile:
    """Fit a reference.  ``exact=False`` takes the bin edges from a sketch, for tables whose
    values are too many to count one by one."""
    numeric, text = columns_by_type(table)
    spark = table.sparkSession
    values = numeric_values(table, numeric) if numeric else None

    def ranked() -> tuple[DataFrame, DataFrame]:
        sketches = stage(quantiles.sketched(values, bins), "sketches")
        return sketches, stage(quantiles.ranked_edges(values, sketches, bins), "edges")

    def rough() -> tuple[DataFrame, DataFrame]:
        stats = stage(column_stats(values), "stats")
        return stats, stage(approximate_edges(values, bins), "edges")

    steps = {}
    if numeric:
        steps["numeric"] = ranked if exact else rough
    if text:
        steps["shares"] = lambda: stage(category_shares(category_values(table, text)), "shares")
    found = together(spark, **steps)
    if numeric:
        stats, edges = found["numeric"]
        # Where the edges' ranks are known, so are the counts between them.
        bin_table = quantiles.bins_of(edges, stats) if exact else histogram(values, edges, bins)
        bin_table = stage(bin_table, "bins")
        edges = quantiles.edge_values(edges) if exact else edges
        # One row per monitored column.
        numeric_table = edges.join(
            F.broadcast(stats.select("feature", "mean", "std", "n_values")), "feature"
        )
    else:
        numeric_table = spark.createDataFrame(
            [], "feature string, edges array<double>, mean double, std double, n_values bigint"
        )
        bin_table = spark.createDataFrame(
            [], "feature string, bin_no int, low double, high double, n bigint, share double"
        )
    if text:
        shares = found["shares"]
    else:
        shares = spark.createDataFrame(
            [], "feature string, value string, n bigint, share double"
        )
    return Profile(numeric_table, bin_table, shares, numeric, text, bins)


def shared_columns(names: list[str], table: DataFrame) -> list[str]:
    """Monitored columns the current table has; the others are skipped."""
    return [name for name in names if name in table.columns]


def level(value: Column, limits: tuple[float, float], rising: bool = True) -> Column:
    warning, critical = limits
    if rising:
        return F.when(value >= critical, "critical").when(value >= warning, "warning").otherwise(
            "none"
        )
    return F.when(value < critical, "critical").when(value < warning, "warning").otherwise("none")


def tally(profile: Profile, current: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, feature, part, n): rows per bin of each numeric and value of each text feature.

    One aggregation for all columns, so it runs on a stream too.  Tallies add up.  Part '0' of
    a numeric feature is out of range; a feature without bins has its own value as 'inside'.
    """
    by = by or []
    none = F.lit(None)
    parts = [
        F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("number"), none.cast("string").alias("text"))
        for n in shared_columns(profile.numeric_names, current)
    ] + [
        F.struct(F.lit(n).alias("feature"), none.cast("double").alias("number"), F.col(n).cast("string").alias("text"))
        for n in shared_columns(profile.category_names, current)
    ]
    rows = current.select(*by, F.inline(F.array(*parts))).where("number is not null or text is not null")
    # One row per monitored column.
    edges = F.broadcast(profile.numeric.select("feature", "edges"))
    bin_no = bin_of(F.col("number"), F.col("edges"), profile.n_bins + 1)
    part = F.when(F.col("number").isNull(), F.col("text")).otherwise(
        F.coalesce(bin_no.cast("string"), F.lit("inside"))
    )
    return rows.join(edges, "feature", "left").groupBy(*by, "feature", part.alias("part")).agg(
        F.count(F.lit(1)).alias("n")
    )


def psi(profile: Profile, current: DataFrame) -> DataFrame:
    """Population stability index per numeric feature.

    Values outside the reference range do not count towards it and are reported apart.
    A feature that was constant in the reference has no bins and index 0.
    """
    names = shared_columns(profile.numeric_names, current)
    edges = profile.numeric.select("feature", "edges").filter(F.col("feature").isin(names))
    counts = (
        binned(numeric_values(current, names), edges, profile.n_bins)
        .groupBy("feature", "bin_no")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return psi_of_counts(profile, stage(counts, "current_bins"))


def psi_of_counts(profile: Profile, counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``psi`` of counted rows (by, feature, bin_no, n), bin 0 being out of range."""
    each = [*(by or []), "feature"]
    seen = counts.groupBy(*each).agg(
        F.sum(F.when(F.col("bin_no") > 0, F.col("n")).otherwise(0)).alias("n_inside"),
        F.sum(F.when(F.col("bin_no") == 0, F.col("n")).otherwise(0)).alias("out_of_range_count"),
    )
    known = profile.bins.select("feature", "bin_no", F.col("share").alias("p"))
    p = F.greatest("p", F.lit(fixed.PSI_FLOOR))
    now = F.coalesce("n", F.lit(0)) / (F.col("n_inside") + fixed.PSI_FLOOR)
    q = F.greatest(now, F.lit(fixed.PSI_FLOOR))
    # A few bins per monitored column.
    every = seen.join(F.broadcast(known), "feature")
    index = (
        every.join(counts.filter("bin_no > 0"), [*each, "bin_no"], "left")
        .groupBy(*each)
        .agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))
    )
    return (
        seen.join(index, each, "left")
        .select(
            *each,
            F.coalesce("psi", F.lit(0.0)).alias("psi"),
            F.col("out_of_range_count"),
        )
        # Decided on the index itself, not on what is shown of it.
        .withColumn("level", level(F.col("psi"), fixed.PSI_LEVELS))
        .withColumn("psi", S.rnd(F.col("psi"), 6))
    )


def chi_square(profile: Profile, current: DataFrame) -> DataFrame:
    """Goodness of fit of each text feature to the reference shares.

    Only categories of the reference count; the others are reported as ``unseen_count``.
    """
    names = shared_columns(profile.category_names, current)
    counts = (
        category_values(current, names)
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = profile.shares.filter(F.col("feature").isin(names)).select("feature").distinct()
    return chi_square_of_counts(profile, stage(counts, "observed"), groups=known)


def chi_square_of_counts(
    profile: Profile, counts: DataFrame, by: list[str] | None = None, groups: DataFrame | None = None
) -> DataFrame:
    """``chi_square`` of counted rows (by, feature, value, n), for every (by, feature) in
    ``groups``, or in the counts.  ``raw`` is the statistic before it is rounded."""
    each = [*(by or []), "feature"]
    shares = profile.shares.select("feature", "value", "share")
    groups = counts.select(*each).distinct() if groups is None else groups
    # Counts and shares have a row per category; both are unique on the key.
    rated = counts.join(shares, ["feature", "value"], "left")
    is_known = F.col("share").isNotNull()
    sizes = groups.join(
        rated.groupBy(*each).agg(
            F.sum(F.when(is_known, F.col("n")).otherwise(0)).alias("size"),
            F.sum(F.when(is_known, 0).otherwise(F.col("n"))).alias("unseen"),
        ),
        each,
        "left",
    ).select(*each, F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("unseen", F.lit(0)).alias("unseen_count"))
    expected = F.col("share") * F.col("size") + 1e-10
    found = F.coalesce("n", F.lit(0)) + 1e-10
    term = (found - expected) * (found - expected) / expected
    return (
        sizes.join(shares, "feature")
        .join(counts, [*each, "value"], "left")
        .groupBy(*each)
        .agg(
            F.sum(term).alias("raw"),
            (F.count(F.lit(1)) - 1).alias("dof"),
            F.max("unseen_count").alias("unseen_count"),
        )
        .withColumn("statistic", S.rnd(F.col("raw"), 6))
    )


def p_value(spark: SparkSession, statistic: float, dof: int) -> float:
    """Chance of a larger statistic, from the distribution that Spark's own tests use."""
    if dof < 1:
        return 1.0
    table = spark.sparkContext._jvm.org.apache.commons.math3.distribution.ChiSquaredDistribution(float(dof))
    return 1.0 - table.cumulativeProbability(float(statistic))


def chi_square_levels(statistics: DataFrame) -> DataFrame:
    """Add the p-value and the level.  The rows, one per monitored column (and window), come
    to the driver for it."""
    spark = statistics.sparkSession
    schema = statistics.schema.add("p_value", DoubleType())
    rows = [(*row, p_value(spark, row["raw"], row["dof"])) for row in statistics.toLocalIterator()]
    rated = spark.createDataFrame(rows, schema)
    return rated.withColumn(
        "level", level(F.col("p_value"), fixed.CHI_LEVELS, rising=False)
    ).withColumn("p_value", S.rnd(F.col("p_value"), 6)).drop("raw")


def score_drift(
    scores: DataFrame, group: str, score: str, reference_mean: Column, reference_std: Column
) -> DataFrame:
    """Distance of each group's mean score from the reference, in standard deviations."""
    z = F.abs(F.col("mean") - reference_mean) / (reference_std + 1e-10)
    warning, critical = fixed.ZSCORE_LEVELS
    rated = F.when(F.col("z") > critical, "critical").when(F.col("z") > warning, "warning")
    return (
        scores.groupBy(group)
        .agg(F.avg(score).alias("mean"))
        .withColumn("z", z)
        .withColumn("level", rated.otherwise("none"))
    )


ALERT_COLUMNS = ["feature", "metric", "value", "threshold", "level", "message"]


def psi_alerts(index: DataFrame, by: list[str] | None = None) -> DataFrame:
    text = F.format_string(fixed.PSI_TEXT, F.col("feature"), F.col("psi"))
    return index.filter(F.col("level") != "none").select(
        *(by or []),
        "feature",
        F.lit("PSI").alias("metric"),
        F.col("psi").alias("value"),
        F.lit(fixed.PSI_LEVELS[0]).alias("threshold"),
        "level",
        text.alias("message"),
    )


def chi_square_alerts(rated: DataFrame, by: list[str] | None = None) -> DataFrame:
    critical = F.col("level") == "critical"
    warning_at, critical_at = fixed.CHI_LEVELS
    lead = F.when(critical, fixed.CHI_LEAD["critical"]).otherwise(fixed.CHI_LEAD["warning"])
    text = F.format_string(fixed.CHI_TEXT, lead, F.col("feature"), F.col("p_value"))
    return rated.filter(F.col("level") != "none").select(
        *(by or []),
        "feature",
        F.lit("chi2_pvalue").alias("metric"),
        F.col("p_value").alias("value"),
        F.when(critical, critical_at).otherwise(warning_at).alias("threshold"),
        "level",
        text.alias("message"),
    )


def score_alerts(rated: DataFrame, group: str) -> DataFrame:
    critical = F.col("level") == "critical"
    warning_at, critical_at = fixed.ZSCORE_LEVELS
    lead = F.when(critical, fixed.SCORE_LEAD["critical"]).otherwise(fixed.SCORE_LEAD["warning"])
    text = F.format_string(fixed.SCORE_TEXT, lead, F.col("z"))
    return rated.filter(F.col("level") != "none").select(
        F.col(group).alias("feature"),
        F.lit("zscore").alias("metric"),
        S.rnd(F.col("z"), 4).alias("value"),
        F.when(critical, critical_at).otherwise(warning_at).alias("threshold"),
        "level",
        text.alias("message"),
    )


def check_counts(profile: Profile, counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All alerts of staged tallies, for each of the ``by`` groups."""
    by = by or []
    numeric = counts.where(F.col("feature").isin(profile.numeric_names) & (F.col("part") != "inside"))
    numeric = numeric.select(*by, "feature", F.col("part").cast("int").alias("bin_no"), "n")
    text = counts.where(F.col("feature").isin(profile.category_names)).withColumnRenamed("part", "value")
    rated = chi_square_levels(chi_square_of_counts(profile, text, by))
    return psi_alerts(psi_of_counts(profile, numeric, by), by).unionByName(chi_square_alerts(rated, by))


def check(
    profile: Profile, current: DataFrame, scores: DataFrame | None = None, group: str = "group"
) -> DataFrame:
    """All alerts for the current table; no rows means no drift.

    ``scores`` adds the alerts of a result of ``score_drift`` by ``group``.
    """
    parts = [] if scores is None else [score_alerts(scores, group)]
    if shared_columns(profile.numeric_names, current):
        parts.append(psi_alerts(psi(profile, current)))
    if shared_columns(profile.category_names, current):
        parts.append(chi_square_alerts(chi_square_levels(chi_square(profile, current))))
    if not parts:
        schema = "feature string, metric string, value double, threshold double, level string, message string"
        return current.sparkSession.createDataFrame([], schema)
    alerts = parts[0]
    for part in parts[1:]:
        alerts = alerts.unionByName(part)
    return alerts


def alert_text(alerts: DataFrame) -> DataFrame:
    """One printable line per alert."""
    mark = F.lit("")
    for name, sign in fixed.LEVEL_MARK.items():
        mark = F.when(F.col("level") == name, sign).otherwise(mark)
    line = F.format_string(
        fixed.ALERT_TEXT,
        mark,
        F.upper("level"),
        F.col("feature"),
        F.col("metric"),
        F.col("value"),
        F.col("threshold").cast("string"),
    )
    return alerts.withColumn("text", line)


def summary(profile: Profile) -> DataFrame:
    """What is monitored, with the number of bins or categories behind each feature."""
    bins = profile.numeric.select(
        "feature", F.lit("numeric").alias("kind"), (F.size("edges") - 1).cast("bigint").alias("n_parts")
    )
    categories = profile.shares.groupBy("feature").agg(F.count(F.lit(1)).alias("n_parts"))
    warning_at, critical_at = fixed.PSI_LEVELS
    return bins.unionByName(
        categories.select("feature", F.lit("categorical").alias("kind"), "n_parts")
    ).select(
        "*",
        F.lit(len(profile.numeric_names)).alias("n_numeric_features"),
        F.lit(len(profile.category_names)).alias("n_categorical_features"),
        F.lit(warning_at).alias("psi_warning"),
        F.lit(critical_at).alias("psi_critical"),
    )
