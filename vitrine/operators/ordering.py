"""Global order without a global sort: dense numbers, lowest n, running totals.

Each works in two steps.  Rows are put in ordered slices; the slices' totals, a table
whose size does not depend on the data, give every slice its starting point; and the
rest happens inside the slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.sources.staging import stage

# Hex digits of the md5 that name a slice: 65536 slices.
SLICE_DIGITS = 4


def digest(key: str) -> Column:
    return F.md5(F.col(key).cast("string"))


def slice_of(key: str) -> Column:
    return F.substring(digest(key), 1, SLICE_DIGITS)


def slice_starts(rows: DataFrame) -> DataFrame:
    """Per slice its size and the total size of the slices before it."""
    sizes = rows.groupBy("slice_no").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.orderBy("slice_no").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(earlier), F.lit(0))
    return sizes.withColumn("before", before)


def dense_index(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Number unique keys 0..n-1, by md5 slice and then by key."""
    sliced = rows.select(key).withColumn("slice_no", slice_of(key))
    inside = F.row_number().over(Window.partitionBy("slice_no").orderBy(key))
    starts = slice_starts(sliced)
    numbered = (
        sliced.withColumn("inside", inside)
        .join(F.broadcast(starts), "slice_no")
        .select(key, (F.col("before") + F.col("inside") - 1).cast("bigint").alias(name))
    )
    return rows.join(numbered, key)


def slice_sizes(rows: DataFrame, key: str, **counts: Column) -> DataFrame:
    """Staged counts of each slice, as many as are asked for, from one pass over the rows."""
    sliced = rows.withColumn("slice_no", slice_of(key)).groupBy("slice_no")
    wanted = counts or {"size": F.lit(True)}
    return stage(sliced.agg(*[F.count_if(c).alias(n) for n, c in wanted.items()]), "slice_sizes")


def lowest_by_hash(
    rows: DataFrame, key: str, n: Column | int, sizes: DataFrame | None = None
) -> Column:
    """Condition that holds for the n rows whose unique key has the lowest md5.

    The slice in which the n-th row lies is found from the slices' sizes and only that
    slice is ranked.  The result is a comparison with one value, so the sample itself is
    a filter of a scan.  ``n`` is a number or a scalar subquery; ``sizes`` may come from
    ``slice_sizes``, with a row for each slice and its ``size``.
    """
    wanted = F.lit(n) if isinstance(n, int) else n
    sizes = slice_sizes(rows, key) if sizes is None else sizes
    earlier = Window.orderBy("slice_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "slice_no", "size", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before")
    )
    has_last = (F.col("before") < wanted) & (F.col("before") + F.col("size") >= wanted)
    order = Window.partitionBy("slice_no").orderBy(digest(key), key)
    place = F.struct(digest(key).alias("hash"), F.col(key).alias("key"))
    last = (
        rows.select(key)
        .withColumn("slice_no", slice_of(key))
        .join(F.broadcast(starts.filter(has_last)), "slice_no")
        .withColumn("inside", F.row_number().over(order))
        .filter(F.col("inside") == wanted - F.col("before"))
        .select(place)
    ).scalar()
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).scalar()
    return (wanted > total) | F.coalesce(place <= last, F.lit(False))


def running_totals(
    rows: DataFrame, order: list[str], counts: list[str], within: list[str] | None = None
) -> DataFrame:
    """Add ``<count>_before``, the total of each count over the rows that sort earlier, and
    ``<count>_total``, the total over all rows.

    ``rows`` must be grouped, one row per ``within`` + ``order``, so equal values cannot
    pile up.  They are cut into even ranges, which are staged so that both readers see
    the same cut.  With ``within`` the totals start anew in each group, however large.
    """
    within = within or []
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(ranges, *[F.col(name) for name in within + order])
    ranged = stage(ranged.withColumn("range_no", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy(*within, "range_no").agg(*[F.sum(c).alias(c) for c in counts])
    group = Window.partitionBy(*within)
    earlier = group.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *within,
        "range_no",
        *[F.sum(c).over(earlier).alias(f"{c}_start") for c in counts],
        *[F.sum(c).over(group).alias(f"{c}_total") for c in counts],
    )
    inside = (
        Window.partitionBy(*within, "range_no")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = ranged.withColumns({f"{c}_inside": F.sum(c).over(inside) for c in counts})
    # At most one row per group and range.
    return local.join(F.broadcast(starts), [*within, "range_no"]).select(
        *rows.columns,
        *[
            (F.coalesce(f"{c}_start", F.lit(0)) + F.coalesce(f"{c}_inside", F.lit(0))).alias(
                f"{c}_before"
            )
            for c in counts
        ],
        *[f"{c}_total" for c in counts],
    )
