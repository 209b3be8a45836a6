"""Repeatable samples: by hash, never by partition or process."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import fixed
from vitrine.functions import scalars as S
from vitrine.operators.features import NEGATIVE_TYPES, negatives_only
from vitrine.operators.ordering import lowest_by_hash, slice_sizes

# Strides for walking the catalogue.  A stride that divides its size is passed over;
# no catalogue is a multiple of all of them.
STRIDES = [7919, 104729, 1299709, 15485863, 32452843, 49979687, 67867967, 86028121]


def sampled_negative(events: DataFrame, ratio: int) -> Column:
    """Condition of the sampled negatives; the counts of both kinds come from one pass."""
    kind = F.col("event_type")
    sizes = slice_sizes(
        events, "event_id", size=kind.isin(NEGATIVE_TYPES), positives=kind == "purchase"
    )
    n_positive = sizes.agg(F.coalesce(F.sum("positives"), F.lit(0))).scalar()
    return lowest_by_hash(negatives_only(events), "event_id", n_positive * ratio, sizes)


def negative_sample(events: DataFrame, ratio: int = 3) -> DataFrame:
    """At most ``ratio`` negatives per purchase.  ``events`` needs a unique ``event_id``."""
    return negatives_only(events).filter(sampled_negative(events, ratio))


def training_union(events: DataFrame, ratio: int = 3) -> DataFrame:
    """Purchases and sampled negatives with their label, from one scan."""
    kind = F.col("event_type")
    negative = kind.isin(NEGATIVE_TYPES) & sampled_negative(events, ratio)
    rows = events.filter((kind == "purchase") | negative)
    return rows.withColumn("label", S.purchase_label(kind))


def split_bucket(key: Column) -> Column:
    return F.pmod(S.hash_number(key.cast("string")), F.lit(100))


def train_split(rows: DataFrame, key: Column, train_share: int = 80) -> DataFrame:
    """Mark each row ``train`` or ``val`` by the hash of its key."""
    split = F.when(split_bucket(key) < train_share, "train").otherwise("val")
    return rows.withColumn("split", split)


def sample_users(users: DataFrame, n: int) -> DataFrame:
    """The n users of least hash: a threshold is worked out, no rows meet in one task."""
    return users.filter(lowest_by_hash(users, "user_id", F.lit(n)))


def strides(n_products: int) -> list[int]:
    """The strides that share no factor with the size of a catalogue."""
    return [stride for stride in STRIDES if n_products % stride != 0]


def with_walks(requests: DataFrame, n_products: int) -> DataFrame:
    """Start, stride (its place among the usable ones) and length of each user's walk."""
    digest = F.md5(F.col("user_id").cast("string"))

    def number(first: int) -> Column:
        return F.conv(F.substring(digest, first, 8), 16, 10).cast("bigint")

    wanted = F.coalesce("candidate_pool", F.lit(fixed.CANDIDATE_POOL[0]))
    return requests.withColumns(
        {
            "walk_start": number(1),
            "walk_layout": F.pmod(number(9), F.lit(len(strides(n_products)))).cast("int"),
            "walk_length": F.least(wanted, F.lit(n_products)).cast("bigint"),
        }
    )


WALK = ["walk_start", "walk_layout", "walk_length"]


def with_candidates(requests: DataFrame, n_products: int) -> DataFrame:
    """Repeat each request for every catalogue position in its candidate pool.

    A user starts at a hashed position and walks with a hashed stride that shares no
    factor with the catalogue size, so no position comes up twice.  Start and stride are
    worked out once per request, the positions by plain arithmetic.  Without a pool size the
    default counts; a pool under one is empty, and so is an empty catalogue's.
    """
    if not n_products:
        return requests.withColumn("product_index", F.lit(0).cast("bigint")).filter(F.lit(False))
    usable = F.array(*[F.lit(stride).cast("bigint") for stride in strides(n_products)])
    walks = with_walks(requests, n_products).withColumn("walk_stride", F.get(usable, F.col("walk_layout")))
    last = F.col("walk_length") - 1
    first = F.lit(0).cast("bigint")
    steps = walks.withColumn("step", F.explode(F.when(last >= 0, F.sequence(first, last))))
    place = F.col("walk_start") + F.col("step") * F.col("walk_stride")
    return steps.withColumn("product_index", F.pmod(place, F.lit(n_products).cast("bigint"))).drop(
        *WALK, "walk_stride", "step"
    )


# Places of a block, without those that it repeats of the next.
BLOCK = 2048


def block_items(products: DataFrame, n_products: int, longest: int) -> DataFrame:
    """(slot, items): the catalogue laid out once for each stride, in blocks of neighbours.

    Put at its position times the inverse of a stride, modulo the catalogue's size, each step
    of a walk lies next to the one before.  A block holds ``BLOCK`` places and the
    ``longest`` - 1 after them, round the end if need be, so a walk of up to ``longest`` steps
    lies whole in the block where it begins.  ``products`` has product_index.
    """
    inverses = [F.lit(pow(stride, -1, n_products)).cast("bigint") for stride in strides(n_products)]
    laid = products.select("*", F.posexplode(F.array(*inverses)).alias("layout", "inverse"))
    place = F.pmod(F.col("product_index") * F.col("inverse"), F.lit(n_products))
    laid = laid.withColumn("place", place)
    laid = laid.withColumn("place", F.explode(F.array("place", F.col("place") + n_products))).where(
        F.col("place") <= n_products + longest - 2
    )
    last = (n_products - 1) // BLOCK
    begin = F.ceil((F.col("place") - (BLOCK + longest - 2)) / BLOCK)
    numbers = F.sequence(
        F.greatest(F.lit(0).cast("bigint"), begin),
        F.least(F.floor(F.col("place") / BLOCK), F.lit(last).cast("bigint")),
    )
    laid = laid.withColumn("block", F.explode(numbers)).select(
        (F.col("layout") * (last + 1) + F.col("block")).alias("slot"), F.struct("place", *products.columns).alias("item")
    )
    # A product may have maps, which have no order, so the places alone are compared.
    in_order = F.array_sort(
        F.collect_list("item"), lambda one, other: (one["place"] - other["place"]).cast("int")
    )
    # Shuffled before they are collected, as nothing gets smaller by collecting.
    return laid.repartition("slot").groupBy("slot").agg(in_order.alias("items"))


def with_blocks(
    requests: DataFrame, products: DataFrame, n_products: int, longest: int
) -> DataFrame:
    """Requests with ``slot`` and the ``items`` of their walk, in its order.

    What is shuffled are requests and one copy of the catalogue for each stride, not pairs.
    Requests meet their block by ``slot``, so grouping by slot and request needs no shuffle.
    No walk may be over ``longest``; a pool under one has no items.
    """
    inverses = [F.lit(pow(stride, -1, n_products)).cast("bigint") for stride in strides(n_products)]
    begin = F.pmod(
        F.pmod(F.col("walk_start"), F.lit(n_products)) * F.get(F.array(*inverses), F.col("walk_layout")),
        F.lit(n_products),
    )
    n_blocks = (n_products - 1) // BLOCK + 1
    placed = with_walks(requests, n_products).withColumn("walk_start", begin)
    slot = (F.col("walk_layout") * n_blocks + F.floor(F.col("walk_start") / BLOCK)).cast("bigint")
    met = placed.withColumn("slot", slot).join(block_items(products, n_products, longest), "slot")
    first = (F.pmod("walk_start", F.lit(BLOCK)) + 1).cast("int")
    length = F.greatest(F.col("walk_length"), F.lit(0)).cast("int")
    return met.withColumn("items", F.slice("items", first, length)).drop(*WALK)
