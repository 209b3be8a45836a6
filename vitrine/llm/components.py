"""Connected components by contraction, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.sources.staging import stage


def _relabelled(links: DataFrame, parents: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        moved = parents.select(F.col("node").alias(side), F.col("parent").alias("new"))
        links = links.join(moved, side).drop(side).withColumnRenamed("new", side)
    return links.where("a != b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is one of its nodes.

    Each round every node points to its smallest neighbour, pointers are followed once more,
    and the links between what is pointed to are the next round's graph.  A hub has one row
    per link and no row that holds them all.  Each round is written to the shared folder.
    """
    links = stage(
        links.where("a != b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    found = None
    while links.limit(1).count():
        ends = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = stage(
            ends.groupBy(F.col("a").alias("node")).agg(
                F.least(F.col("a"), F.min("b")).alias("parent")
            ),
            "nearest",
        )
        far = nearest.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        parents = stage(
            nearest.join(far, "parent").select("node", F.col("next").alias("parent")), "parents"
        )
        if found is None:
            found = parents.select("node", F.col("parent").alias("component"))
        else:
            moved = parents.select(F.col("node").alias("component"), F.col("parent").alias("new"))
            found = stage(
                found.join(moved, "component", "left").select(
                    "node", F.coalesce("new", "component").alias("component")
                ),
                "components",
            )
        links = stage(_relabelled(links, parents), "links")
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found
