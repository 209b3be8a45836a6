"""Exact quantiles without shuffling the values.

One pass makes a mergeable sketch of each feature.  Its guarantee puts every wanted rank
between two of its points, which lie ``1 / STEPS`` of a bin to either side.  A second pass
counts: values inside such a bracket as themselves, all others as a number per gap between
brackets.  Counts are added up before the shuffle, so what is shuffled are the distinct values
inside brackets, some 2 / STEPS of them, and a handful of numbers for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.ordering import running_totals

# Points of the sketch for each bin; its error in rank is a tenth of a point.
STEPS = 100


def sketch_of(value: str, bins: int) -> Column:
    """Aggregate: the values at every point, each off by a tenth of a point's rank at most."""
    points = bins * STEPS
    return F.percentile_approx(value, [i / points for i in range(points + 1)], 10 * points)


def sketched(values: DataFrame, bins: int) -> DataFrame:
    """One pass over (feature, value): the sketch, mean, sample deviation and count."""
    return values.groupBy("feature").agg(
        sketch_of("value", bins).alias("grid"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.count(F.lit(1)).alias("n_values"),
    )


def _brackets(sketches: DataFrame, bins: int) -> DataFrame:
    """Bracket i holds the ranks wanted for edge i; the outermost are open."""
    lows = [F.lit(float("-inf"))] + [F.col("grid")[i * STEPS - 1] for i in range(1, bins + 1)]
    highs = [F.col("grid")[i * STEPS + 1] for i in range(bins)] + [F.lit(float("inf"))]
    names = [F.array(*lows).alias("lows")] + [high.alias(f"high_{i}") for i, high in enumerate(highs)]
    return sketches.select("feature", *names)


def counted_in_brackets(values: DataFrame, sketches: DataFrame, bins: int) -> DataFrame:
    """(feature, gap, value, n) in one pass: values in brackets, and null for those before
    bracket ``gap``."""
    # One row per monitored column.
    rows = values.join(F.broadcast(_brackets(sketches, bins)), "feature")
    gap = F.lit(0)
    for i in range(bins + 1):
        gap = gap + F.when(F.col("value") > F.col(f"high_{i}"), 1).otherwise(0)
    inside = F.coalesce(F.col("value") >= F.get("lows", F.col("gap")), F.lit(True))
    return (
        rows.withColumn("gap", gap)
        .select("feature", "gap", F.when(inside, F.col("value")).alias("value"))
        .groupBy("feature", "gap", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def ranked_edges(values: DataFrame, sketches: DataFrame, bins: int) -> DataFrame:
    """(feature, edges): the quantile edges, linearly interpolated, ascending and distinct, as
    structs of ``edge`` and ``below``, the number of values under it."""
    counted = counted_in_brackets(values, sketches, bins).withColumn("inside", F.col("value").isNotNull())
    ranked = running_totals(counted, ["gap", "inside", "value"], ["n"], within=["feature"])
    steps = F.sequence(F.lit(0), F.lit(bins))
    end = F.col("n_total") - 1
    wanted = F.transform(
        steps, lambda i: F.struct(i.alias("edge_no"), (end * i / bins).alias("position"))
    )
    low, high = F.floor("want.position"), F.ceil("want.position")
    first, last = F.col("n_before"), F.col("n_before") + F.col("n") - 1
    holders = (
        ranked.where("inside")
        .withColumn(
            "wanted",
            F.filter(
                wanted,
                lambda w: F.floor(w["position"]).between(first, last)
                | F.ceil(w["position"]).between(first, last),
            ),
        )
        .select("feature", "value", "n", "n_before", F.explode("wanted").alias("want"))
    )

    def at(rank: Column, name: str) -> Column:
        return F.max(F.when(rank.between(first, last), F.col(name)))

    edges = holders.groupBy("feature", "want.edge_no").agg(
        at(low, "value").alias("lower"),
        at(high, "value").alias("upper"),
        at(low, "n_before").alias("below_lower"),
        at(high, "n_before").alias("below_upper"),
        F.max(F.col("want.position") - low).alias("part"),
    )
    edge = F.col("lower") + (F.col("upper") - F.col("lower")) * F.col("part")
    # Between two neighbours in rank there is no other value.
    below = F.when(F.col("edge") == F.col("lower"), F.col("below_lower")).otherwise(F.col("below_upper"))
    return (
        edges.withColumn("edge", edge)
        .withColumn("below", below)
        .groupBy("feature")
        .agg(F.sort_array(F.collect_set(F.struct("edge", "below"))).alias("edges"))
    )


def edge_values(edges: DataFrame) -> DataFrame:
    return edges.withColumn("edges", F.col("edges.edge"))


def bins_of(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """(feature, bin_no, low, high, n, share) from ranked edges and each feature's
    ``n_values``, without another pass: what is under an edge is known."""
    last = F.size("edges") - 1
    rows = edges.join(F.broadcast(sizes.select("feature", "n_values")), "feature").where(last > 0).select(
        "feature", "edges", "n_values", F.explode(F.sequence(F.lit(1), last)).alias("bin_no"), last.alias("last")
    )
    this, following = F.get("edges", F.col("bin_no") - 1), F.get("edges", F.col("bin_no"))
    # The last bin is closed on the right.
    upto = F.when(F.col("bin_no") == F.col("last"), F.col("n_values")).otherwise(following["below"])
    n = upto - this["below"]
    return rows.select(
        "feature", "bin_no", this["edge"].alias("low"), following["edge"].alias("high"),
        n.alias("n"), (n / F.col("n_values")).alias("share"),
    )
