"""Product similarity, diversity penalty and diversity re-ranking.

Similarity depends only on whether cluster and category match and on how many price
tiers lie between, so all its values fit a table of twenty entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from vitrine import fixed
from vitrine.functions import kernels
from vitrine.functions import scalars as S
from vitrine.operators.skew import lookup_join
from vitrine.sources.staging import stage

TIERS = len(fixed.PRICE_TIER_BOUNDS)


def trait_columns() -> list[Column]:
    return [
        F.col("style_cluster").alias("cluster"),
        F.col("category"),
        S.price_tier(F.col("current_price")).alias("tier"),
    ]


def similarity_columns(left: str, right: str) -> Column:
    """Similarity of two struct columns with cluster, category and tier."""
    sides = [
        {name: F.col(side)[name] for name in ("cluster", "category", "tier")}
        for side in (left, right)
    ]
    return S.similarity(*sides)


def penalty(weight: Column, likeness: Column) -> Column:
    return S.rnd(weight * likeness, 4)


def penalty_table(weight: Column) -> Column:
    """Penalty of every possible similarity: by cluster match, category match, tiers apart."""
    entries = []
    for cluster in (0.0, 0.5):
        for category in (0.0, 0.3):
            for apart in range(TIERS):
                likeness = round(cluster + category + 0.2 * (1 - apart / TIERS), 4)
                entries.append(penalty(weight, F.lit(likeness)))
    return F.array(*entries)


def diversity_penalties(ranked: DataFrame, group: str | list[str], weight: Column) -> DataFrame:
    """Penalty of each row of a ranked list against the rows above it; 0 for the first.

    The lists are as long as the k of a top-k report, which bounds the window.
    """
    above = (
        Window.partitionBy(group)
        .orderBy("rank")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    marked = ranked.withColumn("traits", F.struct(*trait_columns())).withColumn(
        "chosen", F.collect_list("traits").over(above)
    )
    traits = F.col("traits")
    likeness = F.array_max(
        F.transform(
            "chosen",
            lambda other: S.similarity(
                {name: traits[name] for name in ("cluster", "category", "tier")},
                {name: other[name] for name in ("cluster", "category", "tier")},
            ),
        )
    )
    value = F.when(F.size("chosen") == 0, 0.0).otherwise(penalty(weight, likeness))
    return marked.withColumn("diversity_penalty", value).drop("traits", "chosen")


greedy_picks = F.arrow_udf(
    kernels.greedy_picks,
    ArrayType(
        StructType()
        .add("position", IntegerType())
        .add("pick_score", DoubleType())
        .add("penalty", DoubleType())
    ),
)


def picks_of(k: Column, weight: Column, diverse: Column) -> Column:
    """The picks of each row's sorted ``candidates``, as positions with their scores."""
    none = F.array_repeat(F.lit(0.0), 4 * TIERS)
    table = F.when(diverse, penalty_table(weight)).otherwise(none)

    def field(name: str) -> Column:
        return F.col("candidates")[name]

    return greedy_picks(
        F.transform(field("neg_score"), lambda score: -score),
        field("cluster"),
        field("category"),
        field("tier"),
        table,
        k,
    )


def lowest_pick(k: Column, weight: Column, diverse: Column) -> Column:
    """The lowest score that one of k picks had when it was picked; null with fewer picks.

    Whatever else there is, with a raw score below it, is not picked: at every step a
    candidate was better, and a penalty only takes away.
    """
    scores = picks_of(k, weight, diverse)["pick_score"]
    return F.when(F.size("candidates") >= k, F.array_min(scores))


def mmr_picks(candidates: DataFrame, k: Column, weight: Column, diverse: Column) -> DataFrame:
    """Diverse top k of each row's ``candidates``, one row per pick.

    A candidate is a struct (neg_score, product_id, cluster, category, tier, ...) and the
    arrays are sorted.  Each step takes the best score minus penalty, the penalty being
    the largest against the picks so far; of equals the higher raw score, then the lower
    id.  ``pick_score`` is the score at the time and ``final_score`` the score against all
    other picks.  Rows that are not ``diverse`` get their plain top k.
    """
    picked = picks_of(k, weight, diverse)
    score = -F.col("candidate.neg_score")
    left = score - F.col("pick.penalty")
    final = F.when(diverse, S.rnd(F.greatest(F.lit(0.0), left), 6)).otherwise(score)
    return (
        candidates.withColumn("picks", picked)
        # Each pick takes its candidate along, so the array is not copied for every pick.
        .withColumn("picks", F.transform("picks", with_candidate))
        .drop("candidates")
        # The outer form keeps the planner from testing the picks, and so from making them twice.
        .select("*", F.posexplode_outer("picks").alias("step", "pick"))
        .filter(F.col("pick").isNotNull())
        .withColumn("candidate", F.col("pick.candidate"))
        .withColumns(
            {
                "rank": F.col("step") + 1,
                "score": score,
                "pick_score": F.col("pick.pick_score"),
                "final_score": final,
                "product_id": F.col("candidate.product_id"),
            }
        )
        .drop("picks", "step", "pick")
    )


def with_candidate(pick: Column) -> Column:
    return F.struct(
        pick["pick_score"].alias("pick_score"),
        pick["penalty"].alias("penalty"),
        F.get("candidates", pick["position"]).alias("candidate"),
    )


def sorted_candidates(score: Column, carried: list[str] = []) -> Column:
    """Aggregate: the candidates of a group, best score first, lower id first among equals."""
    return F.sort_array(
        F.collect_list(
            F.struct(
                (-score).alias("neg_score"),
                F.col("product_id"),
                F.col("cluster"),
                F.col("category"),
                F.col("tier"),
                *[F.col(name) for name in carried],
            )
        )
    )


# Penalties are rounded to four places.
PENALTY_SLACK = 1e-4


def prune(
    rows: DataFrame,
    group: str | list[str],
    k: Column,
    weight: Column,
    diverse: Column,
    cells: bool = False,
) -> DataFrame:
    """Leave out rows that a diverse top ``k`` of their group cannot pick.

    A penalty is at most ``weight``.  While picks are open, one of the k best raw scores is
    free and keeps its score less ``weight`` at least, so a row below the k-th best score less
    ``weight`` is never picked.  Without diversity the k best are all.  With ``cells``, of
    rows that agree in cluster, category and tier, which carry equal penalties, only the best
    k stay.  Adds ``kth``, the k-th best score, null in smaller groups, and ``pool_size``.
    """
    best = [F.desc("score"), F.asc("product_id")]
    group = [group] if isinstance(group, str) else group
    every = Window.partitionBy(*group)
    placed = rows.withColumn("place", F.row_number().over(every.orderBy(*best)))
    placed = placed.withColumns(
        {
            "kth": F.min(F.when(F.col("place") <= k, F.col("score"))).over(every),
            "pool_size": F.count(F.lit(1)).over(every),
        }
    )
    reach = F.col("kth") - F.when(diverse, weight + PENALTY_SLACK).otherwise(0.0)
    kept = placed.where(
        F.when(diverse, F.col("score") >= reach).otherwise(F.col("place") <= k)
    ).withColumn("kth", F.when(F.col("pool_size") >= k, F.col("kth")))
    if cells:
        cell = Window.partitionBy(*group, "cluster", "category", "tier").orderBy(*best)
        kept = kept.withColumn("in_cell", F.row_number().over(cell)).where(F.col("in_cell") <= k).drop("in_cell")
    return kept.drop("place")


def prune_sorted(candidates: Column, k: Column, weight: Column, diverse: Column) -> Column:
    """``prune`` for sorted candidates in one array."""
    worst = F.element_at(candidates, F.least(k, F.size(candidates)).cast("int"))["neg_score"]
    near = F.filter(candidates, lambda one: one["neg_score"] <= worst + weight + PENALTY_SLACK)
    able = F.when(diverse, near).otherwise(F.slice(candidates, 1, k))
    return F.when(F.size(candidates) > 0, able).otherwise(candidates)


def mmr_rerank(
    candidates: DataFrame, group: str | list[str], k: Column, weight: Column
) -> DataFrame:
    """Diverse top k per group of (group, product_id, score, cluster, category, tier).

    A group may be a whole catalogue: rows that cannot be picked are left out before those of
    a group are put into one row, and of each cell k stay at most.
    """
    able = prune(candidates, group, k, weight, F.lit(True), cells=True)
    group = [group] if isinstance(group, str) else group
    pools = able.groupBy(*group).agg(
        sorted_candidates(F.col("score")).alias("candidates")
    )
    picks = mmr_picks(pools, k, weight, F.lit(True))
    return picks.select(*group, "rank", "product_id", "score", "pick_score", "final_score")


def similar_products(products: DataFrame, n: int = 5, above: float = 0.5) -> DataFrame:
    """The n most similar products of each product, those with similarity over ``above``.

    Products with equal cluster, category and tier form a cell and share one list, so lists
    are worked out per cell and no pairs of products are formed.  A list can only hold the
    n + 1 lowest ids of a cell (one more, because a product is left out of its own list).
    Cells that share the cluster only are stood for by the n + 1 lowest ids of a cluster and
    tier, those that share the category only by the lowest of a category and tier, and those
    that share neither by the lowest of a tier: any of these that turn out to share more rank
    higher anyway, so enough are left.  Below 0.5 the cluster need not match, below 0.2
    neither need the category.
    """
    cell = ["cluster", "category", "tier"]
    traits = products.select("product_id", *trait_columns())

    def lowest_ids(rows: DataFrame, within: list[str]) -> DataFrame:
        by_id = Window.partitionBy(*within).orderBy("product_id")
        return rows.withColumn("place", F.row_number().over(by_id)).filter(F.col("place") <= n + 1)

    heads = stage(lowest_ids(traits, cell).drop("place"), "cell_heads")
    cells = heads.select(*cell).distinct().withColumn("own", F.struct(*cell))

    def options_by(names: list[str], rows: DataFrame) -> DataFrame:
        """Cells with the ids of cells that agree with them in the named traits."""
        others = rows.select(*names, F.struct(*cell).alias("other"), F.col("product_id").alias("id"))
        return cells.join(others, names).select("own", "other", "id")

    options = options_by(["cluster", "category"], heads).unionByName(
        options_by(["cluster"], lowest_ids(heads, ["cluster", "tier"]))
    )
    if above < 0.5:
        options = options.unionByName(
            options_by(["category"], lowest_ids(heads, ["category", "tier"]))
        )
    if above < 0.2:
        # At most n + 1 rows for each tier.
        few = lowest_ids(heads, ["tier"]).agg(
            F.collect_list(F.struct(F.struct(*cell).alias("other"), F.col("product_id").alias("id")))
        ).scalar()
        options = options.unionByName(cells.select("own", F.inline(few)))
    options = options.distinct().withColumn("similarity", similarity_columns("own", "other")).filter(
        F.col("similarity") > above
    )
    best_first = Window.partitionBy("own").orderBy(F.desc("similarity"), "id")
    lists = (
        options.withColumn("place", F.row_number().over(best_first))
        .filter(F.col("place") <= n + 1)
        .groupBy("own")
        .agg(F.sort_array(F.collect_list(F.struct("place", "id", "similarity"))).alias("options"))
        .select("own.*", "options")
    )
    # A cell may hold a large part of the catalogue, so the lists are looked up by one key.
    cell_key = F.to_json(F.struct(*cell))
    lists = stage(lists.select(cell_key.alias("cell_key"), "options"), "similar")
    others = F.filter("options", lambda option: option["id"] != F.col("product_id"))
    return (
        lookup_join(traits.select("product_id", cell_key.alias("cell_key")), lists, "cell_key")
        .select("product_id", F.posexplode(F.slice(others, 1, n)))
        .select(
            "product_id",
            (F.col("pos") + 1).alias("place"),
            F.col("col.id").alias("similar_id"),
            F.col("col.similarity").alias("similarity"),
        )
    )
