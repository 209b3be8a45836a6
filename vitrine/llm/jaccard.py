"""N-gram Jaccard join by filtering under several global token orders.

Documents link when the Jaccard similarity of their sets of five-word shingles is 0.8 or
more.  Put any total order on all shingles: linked sets of n shingles must share one of
their n - ceil(0.8 n) + 1 first.  One order puts rare shingles first and makes the index,
since what is rare is shared by few.  Two more orders, by hash, filter the candidates: a
pair must share a prefix shingle under each of them before the sets are intersected.

Rarity is a count over all documents in a fixed number of hash buckets.  Its error only
moves a shingle in the order; any order gives the same links.

Equal sets are one class from the start.  Inside a group of documents that share a prefix
shingle not all pairs are formed: first each is paired with the document that shares most
of its prefix, an original rather than a copy, which joins groups of near copies.  Then, in
groups that still hold several components, the documents outside the largest are paired
with those of other components.  No link between components is lost, and links inside one
cannot change it.

Words are runs without ASCII white space, A-Z lower-cased.  Fewer than five words are one
shingle.  Null, empty and blank texts have no shingles and link with nothing, not with each
other either.  A class's id is the smallest doc_id in it.  Rows alike in doc_id and text
are in one class.  Sets and shingles are known by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from vitrine.llm.common import broadcast_below, portions, text_key
from vitrine.llm.components import components
from vitrine.sources.staging import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 5
BUCKET_BITS = 20
SLICES = 64
# Multipliers that make the other orders.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
# Documents above a bucket's usual load from which a shingle's group is spread over tasks.
HOT = 10_000
# Pivots of each group, by round of pairing with them.
ROUNDS = ((1,), (2, 3))
SPREAD = 64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


STEP = 0xD6E8FEB86659FD93
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
# Text bytes hashed together.
SLICE = 1 << 16


def _windows(words: np.ndarray, width: int) -> np.ndarray:
    mixed = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        mixed = mix(mixed ^ words[k : k + len(mixed)])
    return mixed


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles, hashed many texts at a time."""
    found: list[np.ndarray] = []
    held, size = [], 0
    for text in texts:
        held.append((text or "").encode())
        size += len(held[-1])
        if size >= SLICE:
            found += _hashed(held)
            held, size = [], 0
    return found + (_hashed(held) if held else [])


def _hashed(texts: list[bytes]) -> list[np.ndarray]:
    raw = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)  # ASCII letters only
    ends = np.cumsum([len(t) + 1 for t in texts])
    blank = BLANK[raw]
    first = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    after = np.flatnonzero(blank & np.append(False, ~blank[:-1]))
    power = np.cumprod(np.full(len(raw), STEP, np.uint64))
    inverse = np.cumprod(np.full(len(raw), pow(STEP, -1, 1 << 64), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[raw] * power)])
    words = mix((sums[after] - sums[first]) * inverse[first] ^ (after - first).astype(np.uint64))
    cuts = np.searchsorted(first, np.append(0, ends))
    wide = _windows(words, WIDTH) if len(words) >= WIDTH else None
    out = []
    for low, high in zip(cuts[:-1], cuts[1:]):
        if high - low >= WIDTH:
            out.append(_distinct(wide[low : high - WIDTH + 1]))
        elif high > low:
            out.append(_windows(words[low:high], high - low))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def fingerprint(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def _schema(frame: DataFrame, more: str) -> StructType:
    kept = [StructField(f.name, f.dataType) for f in frame.schema if f.name != "text"]
    return StructType(kept + StructType.fromDDL(more).fields)


def _profile(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Set size and fingerprint of each text, and at the end the bucket counts in slices."""
    counts = np.zeros(1 << BUCKET_BITS, np.uint32)
    shift = np.uint64(64 - BUCKET_BITS)
    for batch in portions(batches):
        sets = shingle_sets(batch.column("text").to_pylist())
        if not sets:
            continue
        counts += np.bincount(
            (np.concatenate(sets) >> shift).astype(np.int64), minlength=len(counts)
        ).astype(np.uint32)
        kept = batch.drop_columns(["text"])
        nodes = [fingerprint(s) if len(s) else None for s in sets]
        empty = [pa.nulls(len(sets), schema.field(k).type) for k in ("slice", "counts")]
        sizes = pa.array([len(s) for s in sets], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array(nodes, pa.int64()), sizes, *empty], schema=schema
        )
    if counts.any():
        slices = counts.reshape(SLICES, -1)
        last = [pa.nulls(SLICES, f.type) for f in schema][:-2]
        yield pa.RecordBatch.from_arrays(
            [*last, pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in slices], pa.binary())],
            schema=schema,
        )


def _summed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sum of the counts of each slice; holds a sum for each and streams the rest."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            more = np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64)
            sums[at] = sums[at] + more if at in sums else more
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())],
            schema=schema,
        )


def _prefixes(batches: Iterator[pa.RecordBatch], schema: pa.Schema, shared) -> Iterator[pa.RecordBatch]:
    """(node, n, prefix, hot): the rarest shingles of each set, and whether each is hot."""
    shift = np.uint64(64 - BUCKET_BITS)
    load, usual = shared.value
    for batch in portions(batches):
        nodes, sizes, first, hot, lengths = [], [], [], [], []
        for values in shingle_sets(batch.column("text").to_pylist()):
            heavy = load[(values >> shift).astype(np.int64)]
            order = np.lexsort((values, heavy))[: prefix_length(len(values))]
            nodes.append(fingerprint(values))
            sizes.append(len(values))
            first.append(values[order].view(np.int64))
            hot.append(heavy[order] > usual + HOT)
            lengths.append(len(order))
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        if nodes:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(nodes, pa.int64()),
                    pa.array(sizes, pa.int32()),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(first))),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(hot))),
                ],
                schema=schema,
            )


def _sets(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(node, second, third, shingles): the prefixes under the other orders and the set.

    Of the prefixes half of each hash is kept, which can only let more candidates through.
    """
    for batch in portions(batches):
        rows: list[list] = [[], [], [], []]
        for values in shingle_sets(batch.column("text").to_pylist()):
            p = prefix_length(len(values))
            rows[0].append(fingerprint(values))
            for at, step in enumerate(ORDERS):
                order = np.argsort(values * np.uint64(step), kind="stable")[:p]
                rows[1 + at].append(values[order].astype(np.uint32).view(np.int32))
            rows[3].append(values.view(np.int64))
        if rows[0]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(r, f.type) for r, f in zip(rows, schema)], schema=schema
            )


def _groups(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token: those that share it with another.  Streams, holding one row."""
    held = None  # the last row seen, whose successor is not known yet
    before = None  # the token before it
    for batch in batches:
        columns = [np.asarray(batch.column(k)) for k in range(5)]
        if held is not None:
            columns = [np.concatenate([[a], b]).astype(b.dtype) for a, b in zip(held, columns)]
        if not len(columns[0]):
            continue
        held = [c[-1] for c in columns]
        if len(columns[0]) > 1:
            found = _shared([c[:-1] for c in columns], before, held[0], schema)
            before = columns[0][-2]
            if found.num_rows:
                yield found
    if held is not None:
        found = _shared([np.array([x]) for x in held], before, None, schema)
        if found.num_rows:
            yield found


def _shared(columns, before, following, schema) -> pa.RecordBatch:
    token, node, size, place, hot = columns
    same = token[1:] == token[:-1]
    pick = np.append(before is not None and token[0] == before, same)
    pick |= np.append(same, following is not None and token[-1] == following)
    pick |= hot.astype(bool)  # a hot token's other rows may be in another task
    arrays = token, node, size.astype(np.int32), place.astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(x[pick]) for x in arrays], schema=schema)


def profiles(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, text_key, node, n) of each row, and the counts of all shingles by bucket."""
    texts = docs.select("doc_id", text_key().alias("text_key"), "text")
    struct = _schema(texts, "node long, n int, slice int, counts binary")
    schema = to_arrow_schema(struct)
    rows = stage(texts.mapInArrow(lambda b: _profile(b, schema), struct), "shingle-profiles")
    sum_struct = StructType.fromDDL("slice int, counts binary")
    sum_schema = to_arrow_schema(sum_struct)
    sums = (
        rows.where("slice is not null")
        .select("slice", "counts")
        .repartition("slice")
        .mapInArrow(lambda b: _summed(b, sum_schema), sum_struct)
    )
    load = np.zeros((SLICES, (1 << BUCKET_BITS) // SLICES), np.int64)
    # A fixed number of buckets comes to the driver, whatever the corpus.
    for row in sums.toLocalIterator():
        load[row["slice"]] = np.frombuffer(row["counts"], np.int64)
    return rows.where("slice is null").drop("slice", "counts"), load.ravel()


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The text of one document for each wanted (doc_id, text_key)."""
    wanted = broadcast_below(wanted, 32).alias("w")
    return (
        docs.select("doc_id", text_key().alias("text_key"), "text")
        .alias("d")
        .join(
            wanted,
            F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))
            & (F.col("d.text_key") == F.col("w.text_key")),
            "left_semi",
        )
        .select("text")
    )


def _sets_of(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = classes.join(nodes, "node", "left_semi").select("doc_id", "text_key")
    struct = StructType.fromDDL("node long, second array<int>, third array<int>, shingles array<long>")
    schema = to_arrow_schema(struct)
    texts = _texts_of(docs, stage(wanted, "candidate-documents"))
    return stage(texts.mapInArrow(lambda b: _sets(b, schema), struct), "shingle-sets")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that share a prefix under the other orders and are similar enough."""
    sets = _sets_of(docs, classes, pairs)

    def with_both(frame: DataFrame, *columns: str) -> DataFrame:
        for side in "ab":
            named = [F.col(c).alias(f"{c}_{side}") for c in columns]
            frame = frame.join(sets.select(F.col("node").alias(side), *named), side)
        return frame

    filtered = stage(
        with_both(pairs, "second", "third")
        .where(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b"))
        .select("a", "b"),
        "filtered-pairs",
    )
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    # 100 * common >= 80 * union, where union = n_a + n_b - common
    similar = 9 * common >= 4 * (F.size("shingles_a") + F.size("shingles_b"))
    return with_both(filtered, "shingles").where(similar).select("a", "b")


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _sizes_fit(x: str, y: str) -> Column:
    return 5 * F.least(x, y) >= 4 * F.greatest(x, y)


def _groups_once(shared: DataFrame) -> DataFrame:
    """(token, node, n, pos, weight): one token for each group of nodes.

    Copies share many tokens, all with the same nodes; one of these is enough, with each
    node's first place among them.  A node's weight is the share of its prefix that others
    have too: an original has a higher one than its edited copies.
    """
    alike = (
        shared.groupBy("token")
        .agg(
            F.count("*").alias("nodes"),
            F.sum(F.shiftright(F.xxhash64("node"), 20)).alias("sum"),
            F.bit_xor(F.xxhash64(F.lit("x"), "node")).alias("mixed"),
        )
        .where("nodes > 1")
    )
    alike = stage(alike, "token-groups")
    named = alike.groupBy("nodes", "sum", "mixed").agg(F.min("token").alias("group"))
    group_of = alike.join(named, ["nodes", "sum", "mixed"]).select("token", "group")
    weights = shared.groupBy("node").agg((F.count("*") / F.max("n")).alias("weight"))
    return (
        shared.join(group_of, "token")
        .groupBy(F.col("group").alias("token"), "node")
        .agg(F.max("n").alias("n"), F.min("pos").alias("pos"))
        .join(weights, "node")
        .select("token", "node", "n", "pos", "weight")
    )


def _may_link(n: str, pos: str, other_n: str, other_pos: str) -> Column:
    """Whether sizes and places leave room for enough common shingles.

    If a common prefix shingle is a pair's first, all others come after it in both sets.
    Linked sets pass at their first common shingle, so they pass somewhere.
    """
    rest = F.least(F.col(n) - F.col(pos), F.col(other_n) - F.col(other_pos))
    return _sizes_fit(n, other_n) & (9 * rest >= 4 * (F.col(n) + F.col(other_n)))


def _joined(docs: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, component) of all nodes that have links.

    Not all links are found, but all that join components.  In each round the rows outside
    their group's largest component are paired with pivots of the group, by falling weight.
    What is still apart after the last round is paired with all rows of other components, so
    nothing is missed.
    """
    heaviest = Window.partitionBy("token").orderBy(F.desc("weight"), "node")
    pivots = stage(
        groups.withColumn("place", F.row_number().over(heaviest))
        .where(F.col("place") <= max(ROUNDS[-1]))
        .select(
            "token",
            "place",
            F.col("node").alias("pivot"),
            F.col("n").alias("pivot_n"),
            F.col("pos").alias("pivot_pos"),
        ),
        "pivots",
    )
    tried, links = None, None
    for places in (*ROUNDS, None):
        if links is None:
            members = groups.withColumn("component", F.col("node"))
            outside = open_rows = members.withColumn("largest", F.lit(None).cast("long"))
        else:
            placed = components(links)
            members = groups.join(placed, "node", "left").withColumn(
                "component", F.coalesce("component", "node")
            )
            members = stage(members, "group-members")
            parts = members.groupBy("token", "component").count()
            torn = (
                parts.groupBy("token")
                .agg(F.count("*").alias("parts"), F.max_by("component", "count").alias("largest"))
                .where("parts > 1")
                .select("token", "largest")
            )
            open_rows = stage(members.join(torn, "token"), "open-groups")
            outside = open_rows.where("component != largest")
            if not outside.limit(1).count():
                return placed
        if places:
            these = pivots.where(F.col("place").isin(*places)).drop("place")
            if links is not None:
                of_pivot = members.select("token", F.col("node").alias("pivot"), F.col("component").alias("of_pivot"))
                these = these.join(of_pivot, ["token", "pivot"])
            else:
                these = these.withColumn("of_pivot", F.col("pivot"))
            pairs = (
                outside.join(these, "token")
                .where(
                    (F.col("component") != F.col("of_pivot"))
                    & _may_link("n", "pos", "pivot_n", "pivot_pos")
                )
                .select(*_pair("node", "pivot"))
            )
        else:
            x, y = outside.alias("x"), open_rows.alias("y")
            # Both outside the largest: formed once, from the smaller node.
            once = (F.col("y.component") == F.col("y.largest")) | (
                F.col("x.node") < F.col("y.node")
            )
            apart = F.col("x.component") != F.col("y.component")
            pairs = (
                x.join(y, F.col("x.token") == F.col("y.token"))
                .where(apart & once & _may_link("x.n", "x.pos", "y.n", "y.pos"))
                .select(*_pair("x.node", "y.node"))
            )
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stage(pairs, "candidate-pairs")
        new = stage(_verified(docs, classes, pairs), "verified-pairs")
        tried = pairs if tried is None else tried.unionAll(pairs)
        links = new if links is None else links.unionAll(new)
    return components(links)


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, node, component): component is a node, the same for linked rows."""
    rows, load = profiles(docs)
    classes = rows.where("node is not null").groupBy("node").agg(
        F.min(F.struct("doc_id", "text_key")).alias("r")
    )
    classes = stage(classes.select("node", "r.doc_id", "r.text_key"), "shingle-classes")

    struct = StructType.fromDDL("node long, n int, prefix array<long>, hot array<boolean>")
    schema = to_arrow_schema(struct)
    known = docs.sparkSession.sparkContext.broadcast((load, np.median(load)))
    prefixes = _texts_of(docs, classes.select("doc_id", "text_key")).mapInArrow(
        lambda b: _prefixes(b, schema, known), struct
    )
    index = prefixes.select(
        "node", "n", F.posexplode(F.arrays_zip("prefix", "hot")).alias("pos", "p")
    ).select(F.col("p.prefix").alias("token"), "node", "n", "pos", F.col("p.hot").alias("hot"))
    salt = F.when(F.col("hot"), F.pmod("node", F.lit(SPREAD))).otherwise(0)
    dealt = index.withColumn("salt", salt).repartition("token", "salt").sortWithinPartitions(
        "token", "salt"
    )
    group_struct = StructType.fromDDL("token long, node long, n int, pos int")
    group_schema = to_arrow_schema(group_struct)
    shared = stage(
        dealt.select("token", "node", "n", "pos", "hot").mapInArrow(
            lambda b: _groups(b, group_schema), group_struct
        ),
        "shared-prefixes",
    )
    known.destroy()
    groups = stage(_groups_once(shared), "prefix-groups")
    found = _joined(docs, classes, groups)
    return (
        rows.join(found, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .select("doc_id", "text_key", "n", "node", "component")
    )


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    rows = stage(linked(docs), "jaccard-classes")
    names = rows.where("component is not null").groupBy("component").agg(
        F.min("doc_id").alias("smallest"), F.count("*").alias("members")
    )
    return rows.join(names, "component", "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("smallest", "doc_id").alias("component_id"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, the first by doc_id and text, with all columns of ``docs``."""
    rows = stage(linked(docs), "jaccard-classes")
    stays = rows.where("component is not null").groupBy("component").agg(
        F.min(F.struct("doc_id", "text_key")).alias("r"), F.count("*").alias("members")
    )
    # Of a row that stands there several times, one stays too.
    lone = rows.where("component is null").select("doc_id", "text_key").distinct()
    keep = stage(stays.select("r.doc_id", "r.text_key").unionAll(lone), "kept-documents")
    # A document travels in a column of its own, whatever its columns are called.
    keyed = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_key().alias("key")
    ).alias("d")
    kept = keyed.join(
        broadcast_below(keep, 32).alias("k"),
        F.col("d.id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.key") == F.col("k.text_key")),
        "left_semi",
    )
    if rows.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["id", "key"])
    return kept.select("row.*")
