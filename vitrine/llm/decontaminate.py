"""Benchmark decontamination: which documents hold a benchmark item.

An item is held when at least 80 % of its distinct five-word shingles are in the document
(lower-cased words; a text of fewer words is one shingle).  Jaccard similarity says little
here, since an item of thirty words is a speck in a document of twenty thousand.  The
search is one-permutation MinHash for containment: shingles are ranked by hash, and an
item of n shingles that is held to 80 % must share one of its n - ceil(0.8 n) + 1 lowest
hashes with the document.  That many lowest hashes are the item's signature, so the
candidates are complete, not merely likely.  Items are partitioned by size in powers of
two; a document is only searched for partitions whose items it is large enough to hold.
Candidates are verified by intersecting the exact sets.

Null and empty texts have no shingles and hold nothing.  Rows alike in doc_id and text are
one document, items alike in item_id and text one item; a null id is an id like any other.
An empty table on either side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import WORD, broadcast_below, let, text_key
from vitrine.sources.staging import stage

WIDTH = 5


def shingle_hashes(text: Column) -> Column:
    """Hashes of all shingles in order, repeats included."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - WIDTH),
            lambda i: F.xxhash64(*[h[i + k] for k in range(WIDTH)]),
        )

    return let(
        hashes,
        lambda h: F.when(F.size(h) >= WIDTH, windows(h))
        .when(F.size(h) > 0, F.array(F.xxhash64(F.lit("short"), h)))
        .otherwise(F.array().cast("array<bigint>")),
    )


def needed(n: Column, percent: int) -> Column:
    """Shingles that make up the percentage of n."""
    return ((n * percent + 99) / 100).cast("int")


def item_sets(items: DataFrame, percent: int) -> DataFrame:
    return (
        items.select("item_id", F.array_distinct(shingle_hashes(F.col("text"))).alias("shingles"))
        .where(F.size("shingles") > 0)
        .distinct()
        .select(
            F.xxhash64("item_id", "shingles").alias("item"),
            "item_id",
            F.array_sort("shingles").alias("shingles"),
            F.size("shingles").alias("n_item"),
            needed(F.size("shingles"), percent).alias("need"),
            F.floor(F.log2(F.size("shingles"))).cast("int").alias("size_class"),
        )
    )


def leaks(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """Pairs (doc_id, text_key, item_id) with n_shared, n_item and containment."""
    sets = stage(item_sets(items, percent), "item-sets")
    signatures = stage(
        sets.withColumn(
            # the least need of the class: what a document must have to hold any of its items
            "class_need",
            needed(F.pow(F.lit(2), F.col("size_class")).cast("int"), percent),
        ).select(
            F.explode(
                F.slice("shingles", F.lit(1), F.col("n_item") - F.col("need") + 1)
            ).alias("hash"),
            "item",
            "class_need",
        ),
        "item-signatures",
    )
    hashed = docs.select("doc_id", text_key().alias("text_key"), shingle_hashes(F.col("text")).alias("h"))
    candidates = stage(
        hashed.select(
            "doc_id", "text_key", F.size("h").alias("n_doc"), F.explode("h").alias("hash")
        )
        .join(broadcast_below(signatures, 40), "hash")
        .where(F.col("n_doc") >= F.col("class_need"))
        .select("doc_id", "text_key", "item")
        .distinct(),
        "leak-candidates",
    )
    wanted = stage(candidates.select("doc_id", "text_key").distinct(), "leak-documents")
    wanted = broadcast_below(wanted, 40).alias("w")
    keyed = docs.select("doc_id", "text", text_key().alias("text_key")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (
        F.col("d.text_key") == F.col("w.text_key")
    )
    texts = (
        keyed.join(wanted, same, "left_semi")
        .dropDuplicates(["doc_id", "text_key"])
        .select(
            "doc_id",
            "text_key",
            F.array_distinct(shingle_hashes(F.col("text"))).alias("h"),
        )
        .alias("t")
    )
    pairs = (
        texts.join(
            candidates.alias("c"),
            F.col("t.doc_id").eqNullSafe(F.col("c.doc_id"))
            & (F.col("t.text_key") == F.col("c.text_key")),
        )
        .select("t.doc_id", "t.text_key", "t.h", "c.item")
        .join(broadcast_below(sets, 64 + 8 * F.size("shingles")), "item")
    )
    shared = F.size(F.array_intersect("h", "shingles")).cast("long")
    return (
        pairs.select(
            "doc_id",
            "text_key",
            "item_id",
            shared.alias("n_shared"),
            F.col("n_item").cast("long").alias("n_item"),
            "need",
        )
        .where(F.col("n_shared") >= F.col("need"))
        .select(
            "doc_id",
            "text_key",
            "item_id",
            "n_shared",
            "n_item",
            (F.col("n_shared") / F.col("n_item")).alias("containment"),
        )
    )


def without_leaks(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    found = stage(
        leaks(docs, items, percent).select("doc_id", "text_key").distinct(), "leaking"
    )
    found = broadcast_below(found, 40).alias("f")
    return docs.alias("d").join(
        found,
        F.col("d.doc_id").eqNullSafe(F.col("f.doc_id"))
        & (F.xxhash64(F.coalesce(F.col("d.text"), F.lit(""))) == F.col("f.text_key")),
        "left_anti",
    )
