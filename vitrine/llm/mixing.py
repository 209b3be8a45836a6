"""Mix sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets.  Sources ordered by code point (null last) weigh 1, 2, 3, 1, 2, 3, ... and share
   the size of the whole corpus in words.  A target stops at three times its source's size;
   the excess goes to the others by weight.  The end of that resharing is a water level: each
   target is the lesser of its cap and weight times level.
2. Blocks.  A document of up to BLOCK_WORDS words is a block; a longer one is cut into blocks
   of nearly equal length.  The length is the same at every size of the corpus.  A source's
   blocks, in hash order, make one stream of words, which is taken from the start up to three
   times over until the quota is full, so no block is drawn again before all were drawn.  The
   quota is an exact number of words: the last block that a source gives ends with it.
3. Splitting tree.  The root holds every source's quota in draws, runs of words of which a
   shard gets SHARD_DRAWS.  Each node deals half of its draws
   to either child: how many of each source is a multivariate hypergeometric draw, as if all
   draws had been shuffled and cut in two.  The leaves are the output shards.  Only counts
   pass through the tree, never blocks.
4. Shards.  A shard takes the next draws of each source, with the blocks that begin there, so
   shards are disjoint by construction, and orders its blocks by hash.

All draws are hashes of a seed, so a lost task gives the same rows again.  Null text has no
words.  Null is a source of its own.  Sources are few against documents: what is worked out
for them, a row each, passes through one task; what is worked out for documents never does.
Rows alike in doc_id, source and text are copies of one another, each with its own place in
the stream.  An empty table gives no rows, and a corpus without words takes nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import WORD, broadcast_below, let, text_key
from vitrine.sources.staging import stage

SEED = 20_011
# Words of a shard, about; there are eight shards at least.
SHARD_WORDS = 1 << 22
# Draws of a shard, about: how finely the tree deals the quotas out.
SHARD_DRAWS = 1 << 10
BLOCK_WORDS = 4096
# Blocks in one cell of a source's stream, about.
CELL_BLOCKS = 4096
# Parts of a shard that are ordered by themselves: 2 ** 6, by the first bits of the hash.
PART_BITS = 6
MAX_PASSES = 3
# A piece with the white space before it: pieces of a text joined give the text.
PIECE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """One narrow row per document: (doc_id, source, text_key, copy, size)."""
    return (
        docs.select(
            "doc_id",
            "source",
            text_key().alias("text_key"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        )
        .groupBy("doc_id", "source", "text_key", "size")
        .count()
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count"))))
        .drop("count")
    )


def blocks_of(size: Column) -> Column:
    return F.ceil(size / BLOCK_WORDS)


def targets(documents: DataFrame) -> DataFrame:
    """(source, source_no, source_size, n_blocks, target) for each source."""
    totals = documents.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(blocks_of(F.col("size"))).alias("n_blocks")
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(by_name)
    weighed = totals.withColumn("source_no", number).withColumn(
        "weight", ((F.col("source_no") - 1) % 3 + 1).cast("double")
    )
    cap = MAX_PASSES * F.col("source_size").cast("double")
    # Sources that fill up first come first; the first whose own level suffices sets it.
    filling = Window.orderBy(cap / F.col("weight"), "source_no")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = weighed.withColumn(
        "level",
        (
            F.sum("source_size").over(everything)
            - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
        )
        / F.sum("weight").over(onward),
    ).withColumn(
        "place", F.when(F.col("level") * F.col("weight") <= cap, F.row_number().over(filling))
    )
    level = F.min_by("level", "place").over(everything)
    return levels.select(
        "source",
        "source_no",
        "source_size",
        "n_blocks",
        F.least(cap, F.col("weight") * F.coalesce(level, F.lit(0.0))).alias("target"),
    )


def quotas(sources: DataFrame, draw_words: int) -> DataFrame:
    """Adds each source's quota in words and in draws."""
    quota = F.least(F.round("target").cast("long"), MAX_PASSES * F.col("source_size"))
    return sources.withColumn("quota", quota).withColumn(
        "draws", F.ceil(F.col("quota") / draw_words)
    )


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11)
    return bits.cast("double") / float(1 << 53)


def hypergeometric(good: Column, bad: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` from good + bad are good, by inverting the distribution at u.

    Walks the range of twelve standard deviations around the mean; what lies outside weighs
    less than the resolution of u.
    """

    def odds(x: Column, k: Column) -> Column:  # of k + 1 against k
        k = k.cast("double")
        return (x["g"] - k) * (x["n"] - k) / ((k + 1) * (x["b"] - x["n"] + k + 1))

    def bounds(x: Column) -> Column:
        g, b, n = x["g"], x["b"], x["n"]
        total = F.greatest(g + b, F.lit(1.0))
        mean = n * g / total
        spread = 12 * F.sqrt(mean * b / total) + 12
        low = F.greatest(F.lit(0.0), n - b, F.floor(mean - spread).cast("double"))
        high = F.greatest(low, F.least(g, n, F.ceil(mean + spread).cast("double")))
        steps = F.sequence(low.cast("long"), high.cast("long"))
        return let(F.struct(x["g"], x["b"], x["n"], x["u"], steps.alias("steps")), weigh)

    def weigh(x: Column) -> Column:
        def add(s: Column, k: Column) -> Column:
            return F.struct((s["p"] * odds(x, k)).alias("p"), (s["sum"] + s["p"]).alias("sum"))

        start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"))
        whole = F.aggregate(x["steps"], start, add, lambda s: s["sum"])
        return let(whole * x["u"], lambda goal: find(x, goal))

    def find(x: Column, goal: Column) -> Column:
        def step(s: Column, k: Column) -> Column:
            return F.struct(
                (s["p"] * odds(x, k)).alias("p"),
                (s["sum"] + s["p"]).alias("sum"),
                F.when(s["sum"] <= goal, k).otherwise(s["at"]).alias("at"),
            )

        start = F.struct(
            F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("at")
        )
        return F.aggregate(x["steps"], start, step, lambda s: s["at"])

    columns = zip("gbn", (good, bad, draws))
    return let(F.struct(*[c.cast("double").alias(n) for n, c in columns], u.alias("u")), bounds)


def split(quota: Column, node: Column, level: int) -> Column:
    """What the left child of a node gets of each source."""
    total = F.aggregate(quota, F.lit(0).cast("long"), lambda s, q: s + q)

    def deal(s: Column, q: Column) -> Column:
        rest = s["rest"] - q
        place = F.size(s["left"])
        drawn = let(
            hypergeometric(q, rest, s["draws"], uniform(F.lit(level), node, place)),
            lambda x: F.struct(
                F.concat(s["left"], F.array(x)).alias("left"),
                rest.alias("rest"),
                (s["draws"] - x).alias("draws"),
            ),
        )
        return drawn

    return let(
        total,
        lambda t: F.aggregate(
            quota,
            F.struct(
                F.array().cast("array<bigint>").alias("left"),
                t.alias("rest"),
                F.floor(t / 2).alias("draws"),
            ),
            deal,
            lambda s: s["left"],
        ),
    )


def shard_ranges(sources: DataFrame, levels: int) -> DataFrame:
    """Draws [first, last) of each source for each of 2 ** levels shards."""
    root = sources.agg(
        F.array_sort(F.collect_list(F.struct("source_no", "draws"))).alias("quota")
    ).select(F.lit(0).cast("long").alias("node"), F.col("quota.draws").alias("quota"))
    nodes = root
    for level in range(levels):
        halves = nodes.withColumn("left", split(F.col("quota"), F.col("node"), level))
        right = F.transform("quota", lambda q, i: q - F.col("left")[i])
        children = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quota")),
            F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quota")),
        )
        nodes = halves.select(F.explode(children).alias("child")).select("child.*")
    shares = nodes.select(F.col("node").alias("shard"), F.posexplode("quota").alias("at", "share"))
    upto = Window.partitionBy("at").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    last = F.sum("share").over(upto)
    return shares.select(
        "shard",
        (F.col("at") + 1).alias("source_no"),
        (last - F.col("share")).alias("first"),
        last.alias("last"),
    ).where("first < last")


def streamed(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """The documents' blocks, words [from, to), each with its first word in the source's stream.

    A stream is cut into cells by hash, so that no task holds a whole source.
    """
    placed = documents.join(
        sources.select(
            F.col("source").alias("s"), "source_no", "source_size", "n_blocks", "quota", "draws"
        ),
        F.col("source").eqNullSafe(F.col("s")),
    ).drop("s")
    n, number = F.col("n"), F.col("number")
    order = F.xxhash64(F.lit(SEED), "doc_id", "text_key", "copy", "number")
    celled = (
        placed.where("size > 0")
        .withColumn("n", blocks_of(F.col("size")))
        .withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
        .withColumn("from", F.floor(F.col("size") * number / n))
        .withColumn("to", F.floor(F.col("size") * (number + 1) / n))
        .withColumn("order", order)
        .withColumn("cell", F.pmod(F.xxhash64("order"), F.ceil(F.col("n_blocks") / CELL_BLOCKS)))
        .drop("n", "n_blocks")
    )
    words = F.col("to") - F.col("from")
    starts = celled.groupBy("source_no", "cell").agg(F.sum(words).alias("words"))
    before = Window.partitionBy("source_no").orderBy("cell").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = starts.select(
        "source_no", "cell", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("cell_start")
    )
    inside = (
        Window.partitionBy("source_no", "cell")
        .orderBy("order", "doc_id", "text_key", "copy", "number")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        celled.withColumn("inside", F.coalesce(F.sum(words).over(inside), F.lit(0)))
        .join(starts, ["source_no", "cell"])
        .withColumn("start", F.col("cell_start") + F.col("inside"))
        .drop("inside", "cell_start", "cell", "order", "number")
    )


def slotted(pieces: DataFrame) -> DataFrame:
    """Adds ``slot``, the place in the shard's order by hash, counted part by part."""
    names = ["doc_id", "text_key", "copy", "pass", "first"]
    ordered = pieces.withColumn("h", F.xxhash64(F.lit(SEED), F.lit("slot"), "source_no", *names))
    parted = ordered.withColumn("bits", F.shiftright("h", 64 - PART_BITS))
    upto = Window.partitionBy("shard").orderBy("bits").rowsBetween(Window.unboundedPreceding, -1)
    counts = parted.groupBy("shard", "bits").count()
    before = counts.select(
        "shard", "bits", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("shard", "bits").orderBy("h", "source_no", *names)
    return (
        parted.withColumn("place", F.row_number().over(inside))
        .join(before, ["shard", "bits"])
        .withColumn("slot", F.col("before") + F.col("place"))
        .drop("h", "bits", "place", "before")
    )


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents (with source_size and target) and the pieces the mix takes of them.

    A piece is (shard, slot, doc_id, source, text_key, copy, pass, first, last): words
    [first, last) of the document, at place ``slot`` of the shard.
    """
    documents = stage(sized(docs), "mix-sizes")
    total = documents.agg(F.sum("size")).first()[0] or 0
    levels = max(3, math.ceil(math.log2(max(1, total / SHARD_WORDS))))
    draw_words = max(1, total // (SHARD_DRAWS << levels))
    sources = stage(quotas(targets(documents), draw_words), "mix-sources")
    by_source = broadcast_below(sources, 256)
    ranges = shard_ranges(sources, levels).join(
        by_source.select("source_no", "draws"), "source_no"
    )
    # Ranges and draws meet in cells of a mean range's length.
    width = F.greatest(F.ceil(F.col("draws") / 2**levels), F.lit(1))
    ranges = stage(
        ranges.select(
            "shard",
            "source_no",
            F.col("first").alias("first_draw"),
            F.col("last").alias("last_draw"),
            F.explode(
                F.sequence(F.floor(F.col("first") / width), F.floor((F.col("last") - 1) / width))
            ).alias("cell"),
        ),
        "mix-shards",
    )
    passes = F.array(*[F.lit(p) for p in range(MAX_PASSES)])
    drawn = (
        streamed(documents, by_source)
        .withColumn("pass", F.explode(passes))
        .withColumn("at", F.col("pass") * F.col("source_size") + F.col("start"))
        .where("at < quota")
        .withColumn("draw", F.floor(F.col("at") / draw_words))
        .select(
            "doc_id",
            "source",
            "source_no",
            "text_key",
            "copy",
            "pass",
            "draw",
            F.floor(F.col("draw") / width).alias("cell"),
            F.col("from").alias("first"),
            F.least(F.col("to"), F.col("from") + F.col("quota") - F.col("at")).alias("last"),
        )
    )
    pieces = stage(
        drawn.join(broadcast_below(ranges, 64), ["source_no", "cell"])
        .where("draw >= first_draw and draw < last_draw")
        .select(
            "shard", "doc_id", "source", "source_no", "text_key", "copy", "pass", "first", "last"
        ),
        "mix-pieces",
    )
    shown = documents.join(
        by_source.select(F.col("source").alias("s"), "source_size", "target"),
        F.col("source").eqNullSafe(F.col("s")),
    ).drop("s")
    return shown, slotted(pieces).select(
        "shard", "slot", "doc_id", "source", "text_key", "copy", "pass", "first", "last"
    )


IDENTITY = ("doc_id", "source", "text_key", "copy")


def taken(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shard, slot) for each document.

    ``shard`` and ``slot`` are arrays that say where each piece of the document went, in order
    of passes and words.
    """
    documents, pieces = mix(docs)
    places = F.array_sort(F.collect_list(F.struct("pass", "first", "shard", "slot")))
    words = pieces.groupBy(*IDENTITY).agg(
        F.sum(F.col("last") - F.col("first")).alias("taken"), places.alias("places")
    )
    nowhere = F.array().cast("array<bigint>")
    return _matched(documents, words, IDENTITY, "left").select(
        F.col("l.doc_id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0).cast("long")).alias("taken"),
        *(F.coalesce(F.col(f"places.{name}"), nowhere).alias(name) for name in ("shard", "slot")),
    )


def _matched(left: DataFrame, right: DataFrame, names: tuple[str, ...], how: str) -> DataFrame:
    same = F.lit(True)
    for name in names:
        same = same & F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}"))
    return left.alias("l").join(right.alias("r"), same, how)


def runs_of(pieces: Column) -> Column:
    """Pieces (first, last) in order, those that follow on each other as one."""

    def add(done: Column, p: Column) -> Column:
        end = F.try_element_at(done, F.lit(-1))
        longer = F.struct(end["first"].alias("first"), p["last"].alias("last"))
        return F.when(
            end["last"] == p["first"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
        ).otherwise(F.concat(done, F.array(p)))

    return F.aggregate(pieces, F.array().cast("array<struct<first:bigint,last:bigint>>"), add)


def mixed(docs: DataFrame) -> DataFrame:
    """The mix as documents with the columns of ``docs``: for each pass over a document a row
    for each run of words that it takes, holding those words as they stand in the text."""
    _, pieces = mix(docs)
    found = pieces.groupBy(*IDENTITY, "pass").agg(
        F.array_sort(F.collect_list(F.struct("first", "last"))).alias("pieces")
    )
    runs = found.withColumn("runs", runs_of(F.col("pieces"))).drop("pieces")
    names = IDENTITY[:3]
    # A document travels in a column of its own, whatever its columns are called.
    texts = docs.select(
        "doc_id", "source", "text", text_key().alias("text_key"), F.struct("*").alias("row")
    ).dropDuplicates(list(names))
    words = F.regexp_extract_all(F.col("l.text"), F.lit(PIECE), F.lit(0))

    def cut(w: Column) -> Column:
        return F.transform(
            F.col("r.runs"),
            lambda r: F.array_join(
                F.slice(w, r["first"].cast("int") + 1, (r["last"] - r["first"]).cast("int")), ""
            ),
        )

    picked = _matched(texts, runs, names, "inner").withColumn("__run", F.explode(let(words, cut)))
    shown = {
        "text": F.regexp_replace("__run", r"\A[\x20\x09-\x0D]+", ""),
    }
    columns = [
        shown.get(name, F.col(f"l.row.`{name}`")).alias(name) for name in docs.columns
    ]
    out = picked.select(*columns)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.char_length("text").cast(kind))
    return out
