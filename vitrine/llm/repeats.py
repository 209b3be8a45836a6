"""Byte-level removal of strings repeated from earlier documents, by blockwise suffix sorting.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller
doc_id.  The corpus is never sorted as a whole, and no suffix is compared beyond a bucket:

1. Cover sample.  In each 50-byte window the 24-byte string of least hash is the sampled
   suffix.  Equal windows sample the same offset, which is what a difference cover gives any
   two suffixes; choosing by content instead of by residues needs a third of the positions.
   Samples whose string occurs once cannot lie in a repeat.  A fixed-size bit filter of the
   others is built bucket by bucket; its errors only cost time.
2. Sample ranks.  Suffixes are put in buckets by their sampled string, and each bucket is
   sorted by itself: samples get the rank of their whole context, that is, of all windows
   they are sampled for.  Samples of equal rank tie over all those windows at once; every
   one but those of the smallest doc_id is covered.
3. Blocks.  Only samples whose bucket holds several ranks are left, at the ends of repeats.
   Their windows are sorted, again one bucket at a time and in passes of bounded size.

Texts that are equal as a whole are one text with the smallest doc_id, from the start.  Map
tasks rank what they hold, up to HELD samples, before they send it.  A sample that ties with
a smaller doc_id there is covered and passes by the buckets.  Of the others one row for each
rank goes to its bucket, so a frequent string reaches it once from each portion held; the
further places of that document wait outside and join by rank and doc_id if it turns out to
be covered.  Step 3 sends a rank's least document of each portion with all its places, and a
string's different contexts meet in one bucket in both steps: a string whose contexts nearly
all differ is the largest group that a task gets.

Null text is empty.  Texts under 50 bytes keep all bytes.  A null doc_id is smaller than any
other.  Rows that share a doc_id do not remove each other's bytes.  Strings are known by
64-bit hashes, whole texts by MD5.  doc_id must be an integer column.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vitrine.llm.common import broadcast_below, text_key
from vitrine.sources.staging import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 50
GRAM = 24
WINDOWS = WIDTH - GRAM + 1
CONTEXT = WIDTH + WINDOWS - 1
# Bits of a sample filter: 16 MB, whatever the corpus.
FILTER_BITS = 1 << 27
# Text bytes for each bucket.
BUCKET_BYTES = 8 << 20
# Text bytes that are sampled together, and samples that a map task holds before sending.
SLICE = 1 << 16
HELD = 1 << 18
# Windows sorted in one pass.
PASS = 1 << 20
FIRST = -(1 << 63)

U = np.uint64
STEP = 0xD6E8FEB86659FD93
POWERS = np.cumprod(np.full(CONTEXT + 2, STEP, U))
INVERSES = np.cumprod(np.full(CONTEXT + 2, pow(STEP, -1, 1 << 64), U))
SAMPLE = np.dtype([("a", "<u8"), ("c", "<u8"), ("d", "<u4"), ("lo", "<u4"), ("n", "u1")])
EDGE = np.dtype([*SAMPLE.descr, ("text", "u1", CONTEXT)])
# Bytes [low, high) of samples of one rank, and whether the document has more of it; bytes
# that are covered.
SPAN = np.dtype(
    [("a", "<u8"), ("c", "<u8"), ("d", "<u4"), ("low", "<u4"), ("high", "<u4"), ("more", "u1")]
)
COVER = np.dtype([("d", "<u4"), ("low", "<u4"), ("high", "<u4")])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0x9FB21C651E98DF25)
    return x ^ (x >> U(29))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value in each run of ``width``."""
    place, size = np.arange(len(values), dtype=np.int32), 1

    def doubled(values, place, shift):
        left = values[:-shift] <= values[shift:]
        return (
            np.where(left, values[:-shift], values[shift:]),
            np.where(left, place[:-shift], place[shift:]),
        )

    while size * 2 <= width:
        values, place = doubled(values, place, size)
        size *= 2
    if size < width:
        values, place = doubled(values, place, width - size)
    return place


class Samples:
    """The sampled suffixes of some texts, laid end to end."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        self.raw, self.begin = raw, ends - sizes
        empty = np.empty(0, np.int64)
        self.a, self.c = np.empty(0, U), np.empty(0, U)
        self.doc, self.at, self.lo, self.n = empty, empty, empty, empty
        if len(raw) < WIDTH:
            return
        x = raw.astype(U)
        x = x[:-1] | (x[1:] << U(8))
        x = x[:-2] | (x[2:] << U(16))
        x = x[:-4] | (x[4:] << U(32))
        grams = mix(x)  # of eight bytes
        m = len(raw) - GRAM + 1
        hashes = mix(mix(grams[:m] * U(3) ^ x[8:][:m]) * U(3) ^ x[16:][:m])
        place = least(hashes, WINDOWS)
        doc = np.repeat(np.arange(len(texts)), sizes)[: len(place)]
        start = np.arange(len(place))
        inside = start + WIDTH <= ends[doc]
        start, place, doc = start[inside], place[inside], doc[inside]
        if not len(start):
            return
        new = np.append(True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]))
        first = np.flatnonzero(new)
        self.lo = start[first]
        self.n = np.diff(np.append(first, len(start)))
        self.at, self.doc = place[first].astype(np.int64), doc[first]
        self.a = hashes[self.at]
        # The context: a sum over its eight-byte strings, weighted by place.
        spans = self.n + WIDTH - 8
        power = np.cumprod(np.full(len(grams), U(STEP)))
        inverse = np.cumprod(np.full(len(grams), U(pow(STEP, -1, 1 << 64))))
        sums = np.concatenate([[U(0)], np.cumsum(grams * power)])
        value = (sums[self.lo + spans] - sums[self.lo]) * inverse[self.lo]
        shape = ((self.at - self.lo) << 8 | self.n).astype(U)
        self.c = mix(value ^ shape * U(STEP))

    def contexts(self, chosen: np.ndarray) -> np.ndarray:
        """Bytes of the chosen samples' windows, padded with zeros."""
        places = self.lo[chosen][:, None] + np.arange(CONTEXT)
        beyond = np.arange(CONTEXT) >= (self.n[chosen] + WIDTH - 1)[:, None]
        found = self.raw[np.minimum(places, len(self.raw) - 1)]
        found[beyond] = 0
        return found


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, Samples]]:
    """(doc_ids, keys, samples) for some documents at a time."""
    ids, keys, texts, size = [], [], [], 0
    for batch in batches:
        for doc_id, key, text in zip(*(batch.column(k) for k in ("doc_id", "key", "text"))):
            ids.append(FIRST if doc_id.as_py() is None else doc_id.as_py())
            keys.append(key.as_py())
            texts.append(text.as_py().encode())
            size += len(texts[-1])
            if size >= SLICE:
                yield np.array(ids, np.int64), np.array(keys, np.int64), Samples(texts)
                ids, keys, texts, size = [], [], [], 0
    if texts:
        yield np.array(ids, np.int64), np.array(keys, np.int64), Samples(texts)


def bucket_of(a: np.ndarray, buckets: int) -> np.ndarray:
    return ((a >> U(33)) % U(buckets)).astype(np.int64)


def bit_of(a: np.ndarray, buckets: int) -> np.ndarray:
    share = FILTER_BITS // buckets
    return bucket_of(a, buckets) * share + (a.astype(np.uint32) % np.uint32(share)).astype(np.int64)


def bits_set(places: np.ndarray, buckets: int) -> bytes:
    share = FILTER_BITS // buckets
    slots = np.zeros(share, bool)
    slots[places] = True
    return np.packbits(slots).tobytes()


def passing(a: np.ndarray, chosen: np.ndarray, buckets: int) -> np.ndarray:
    bit = bit_of(a, buckets)
    return (chosen[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1


def _packed(part: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> bytes:
    used, place = np.unique(part["d"], return_inverse=True)
    part = part.copy()
    part["d"] = place
    head = np.array([len(used)], "<u4").tobytes()
    return head + ids[used].tobytes() + keys[used].tobytes() + part.tobytes()


def _sent(rows: np.ndarray, buckets: int, ids=None, keys=None):
    """(bucket, blob) of rows that are sorted by their string."""
    bucket = bucket_of(rows if rows.dtype.names is None else rows["a"], buckets)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for low, high in zip(cuts, np.append(cuts[1:], len(rows))):
        part = rows[low:high]
        blob = part.astype(np.uint32).tobytes() if ids is None else _packed(part, ids, keys)
        yield int(bucket[low]), blob


def _merged(group: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Union of each group's spans, which are sorted by group and low."""
    reach = np.maximum.accumulate((group << 33) + high)
    new = np.append(True, (group[1:] << 33) + low[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(group)) - 1
    return group[first], low[first], reach[last] & ((1 << 33) - 1)


def _spans(kind: np.dtype, d, low, high, **more) -> np.ndarray:
    spans = np.zeros(len(d), kind)
    for name, values in {"d": d, "low": low, "high": high, **more}.items():
        spans[name] = values
    return spans


def _settled(rows: np.ndarray, ids: np.ndarray, keys: np.ndarray, buckets: int):
    """(bucket, blob) of samples sorted by string, context and doc_id.

    One span of each rank's least document goes to the bucket of its string.  What is covered
    already, and the least document's further spans, go to buckets beyond those, even and odd
    ones, by a hash that has nothing to do with strings.
    """
    doc = ids[rows["d"]]
    _, new, smallest = _classes(rows, doc)
    rank = np.cumsum(new) - 1
    low = rows["lo"].astype(np.int64)
    high = low + rows["n"] + (WIDTH - 1)
    beyond = buckets + 2 * int(mix(keys[:1].astype(U))[0] % U(buckets))
    gone = np.flatnonzero(doc > smallest)
    if len(gone):
        gone = gone[np.lexsort((low[gone], rows["d"][gone]))]
        found = _merged(rows["d"][gone].astype(np.int64), low[gone], high[gone])
        yield beyond, _packed(_spans(COVER, *found), ids, keys)
    stay = np.flatnonzero(doc == smallest)
    d = rows["d"][stay]
    first = np.append(True, (rank[stay][1:] != rank[stay][:-1]) | (d[1:] != d[:-1]))
    group, low, high = _merged(np.cumsum(first) - 1, low[stay], high[stay])
    at = stay[np.flatnonzero(first)][group]
    spans = _spans(SPAN, rows["d"][at], low, high, a=rows["a"][at], c=rows["c"][at])
    head = np.append(True, rank[at][1:] != rank[at][:-1])
    # Nothing is smaller than a null doc_id.
    rest = spans[~head & (doc[at] > FIRST)]
    spans["more"] = (np.bincount(rank[at]) > 1)[rank[at]]
    yield from _sent(spans[head], buckets, ids, keys)
    if len(rest):
        yield beyond + 1, _packed(rest, ids, keys)


def _batch(sent, schema: pa.Schema) -> pa.RecordBatch:
    buckets, blobs = zip(*sent)
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets, pa.int64()), pa.array(blobs, pa.binary())], schema=schema
    )


def _strings(batches, schema: pa.Schema, buckets: int):
    """Sampled strings; each twice at most, which is all that matters."""
    held: list[np.ndarray] = []

    def send():
        a = np.sort(np.concatenate(held))
        third = np.zeros(len(a), bool)
        third[2:] = a[2:] == a[:-2]
        return _batch(_sent(a[~third], buckets), schema)

    for _, _, samples in sliced(batches):
        held.append(samples.a)
        if sum(map(len, held)) >= HELD:
            yield send()
            held = []
    if sum(map(len, held)):
        yield send()


def _ranked(batches, schema: pa.Schema, buckets: int, chosen: np.ndarray, kind: np.dtype):
    """Samples that pass the filter, for each string and context those of the least doc_id;
    as samples also what that covers."""
    held: list[np.ndarray] = []
    ids: list[np.ndarray] = []
    keys: list[np.ndarray] = []
    docs = 0

    def send():
        rows, doc_ids, doc_keys = np.concatenate(held), np.concatenate(ids), np.concatenate(keys)
        order = np.lexsort((doc_ids[rows["d"]], rows["c"], rows["a"]))
        rows = rows[order]
        if kind is SAMPLE:
            return _batch(_settled(rows, doc_ids, doc_keys, buckets), schema)
        doc = doc_ids[rows["d"]]
        rows = rows[doc == _classes(rows, doc)[2]]
        return _batch(_sent(rows, buckets, doc_ids, doc_keys), schema)

    for some_ids, some_keys, samples in sliced(batches):
        pick = np.flatnonzero(passing(samples.a, chosen, buckets)) if len(samples.a) else []
        if len(pick):
            rows = np.zeros(len(pick), kind)
            rows["a"], rows["c"] = samples.a[pick], samples.c[pick]
            rows["d"] = samples.doc[pick] + docs
            rows["lo"] = samples.lo[pick] - samples.begin[samples.doc[pick]]
            rows["n"] = samples.n[pick]
            if kind is EDGE:
                rows["text"] = samples.contexts(pick)
            held.append(rows)
            ids.append(some_ids)
            keys.append(some_keys)
            docs += len(some_ids)
            if sum(map(len, held)) >= (HELD if kind is SAMPLE else HELD // 4):
                yield send()
                held, ids, keys, docs = [], [], [], 0
    if held:
        yield send()


def _unpacked(blobs: pd.Series, kind: np.dtype):
    rows, ids, keys, docs = [], [], [], 0
    for blob in blobs:
        n = int(np.frombuffer(blob, "<u4", 1)[0])
        ids.append(np.frombuffer(blob, "<i8", n, 4))
        keys.append(np.frombuffer(blob, "<i8", n, 4 + 8 * n))
        part = np.frombuffer(blob, kind, -1, 4 + 16 * n).copy()
        part["d"] += docs
        docs += n
        rows.append(part)
    rows, ids, keys = np.concatenate(rows), np.concatenate(ids), np.concatenate(keys)
    return rows, ids[rows["d"]], keys[rows["d"]]


def _opened(blobs: pd.Series, kind: np.dtype):
    rows, doc, key = _unpacked(blobs, kind)
    order = np.lexsort((doc, rows["c"], rows["a"]))
    return rows[order], doc[order], key[order]


def _classes(rows: np.ndarray, doc: np.ndarray):
    """Number of each row's rank, whether it is the first of a string, and the rank's doc_id."""
    string = np.append(True, rows["a"][1:] != rows["a"][:-1])
    new = string | np.append(True, rows["c"][1:] != rows["c"][:-1])
    rank = np.cumsum(new) - 1
    return string, new, doc[np.flatnonzero(new)][rank]


COVERS = "doc_id long, key long, low int, high int"
RANKED = f"kind int, a long, c long, {COVERS}, bits binary"
COVERED, MARK, WAITING, LOST = range(4)


def _covers(doc, key, low, high) -> pd.DataFrame:
    return pd.DataFrame(
        {"doc_id": doc, "key": key, "low": low.astype(np.int32), "high": high.astype(np.int32)}
    )


def _ranks(kind: int, rows: np.ndarray, doc: np.ndarray, key: np.ndarray) -> pd.DataFrame:
    found = _covers(doc, key, rows["low"], rows["high"]).assign(kind=kind, a=0, c=0, bits=None)
    if kind != COVERED:
        found["a"], found["c"] = rows["a"].view(np.int64), rows["c"].view(np.int64)
    return found


def covered_by_rank(bucket: int, blobs: pd.Series, buckets: int) -> pd.DataFrame:
    """Covered spans; those that wait for their rank; ranks lost to a smaller doc_id for
    which some wait; and a mark of the strings with several ranks."""
    names = [field.split()[0] for field in RANKED.split(", ")]
    if bucket >= buckets:
        kind, dtype = (WAITING, SPAN) if (bucket - buckets) % 2 else (COVERED, COVER)
        return _ranks(kind, *_unpacked(blobs, dtype))[names]
    rows, doc, key = _opened(blobs, SPAN)
    string, new, smallest = _classes(rows, doc)
    gone = doc > smallest
    lost = gone & (rows["more"] == 1)
    group = np.cumsum(string) - 1
    several = np.bincount(group[new]) > 1
    strings = rows["a"][np.flatnonzero(string)][several]
    bits = bits_set(bit_of(strings, buckets) - bucket * (FILTER_BITS // buckets), buckets)
    mark = {"kind": MARK, "a": 0, "c": 0, "doc_id": 0, "key": bucket, "low": -1, "high": -1, "bits": bits}
    parts = [pd.DataFrame([mark])]
    if gone.any():
        parts.append(_ranks(COVERED, rows[gone], doc[gone], key[gone]))
    if lost.any():
        ranks = _ranks(LOST, rows[lost], doc[lost], key[lost])
        parts.append(ranks.drop_duplicates(["a", "c", "doc_id"]))
    return pd.concat(parts)[names]


BYTES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def window_hashes(text: np.ndarray) -> np.ndarray:
    """Hashes of the windows at each place of the contexts."""
    sums = np.zeros((len(text), CONTEXT + 1), U)
    np.cumsum(BYTES[text] * POWERS[:CONTEXT], axis=1, out=sums[:, 1:])
    return mix((sums[:, WIDTH:] - sums[:, : WINDOWS]) * INVERSES[:WINDOWS])


def covered_by_sort(blobs: pd.Series) -> pd.DataFrame:
    rows, doc, key = _opened(blobs, EDGE)
    string, new, smallest = _classes(rows, doc)
    # The others of a rank are covered as a whole, which the ranks have shown.
    stay = doc == smallest
    group = (np.cumsum(string) - 1)[stay]
    rows, doc, key = rows[stay], doc[stay], key[stay]
    total = int(rows["n"].sum())
    passes = max(1, -(-total // PASS))
    gone = np.zeros((len(rows), WINDOWS), bool)
    valid = np.arange(WINDOWS) < rows["n"][:, None]
    for step in range(passes):
        found = []
        for low in range(0, len(rows), 1 << 14):
            part = slice(low, low + (1 << 14))
            hashes = window_hashes(rows["text"][part])
            row, at = np.nonzero(valid[part] & (hashes % U(passes) == U(step)))
            found.append((row + low, at, hashes[row, at]))
        row, at, value = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((doc[row], value, group[row]))
        row, at, value = row[order], at[order], value[order]
        if not len(row):
            continue
        first = np.append(True, (value[1:] != value[:-1]) | (group[row][1:] != group[row][:-1]))
        least_doc = doc[row][np.flatnonzero(first)][np.cumsum(first) - 1]
        later = doc[row] > least_doc
        gone[row[later], at[later]] = True
    begin = gone & ~np.pad(gone[:, :-1], ((0, 0), (1, 0)))
    end = gone & ~np.pad(gone[:, 1:], ((0, 0), (0, 1)))
    row, first = np.nonzero(begin)
    _, last = np.nonzero(end)
    lo = rows["lo"][row].astype(np.int64)
    return _covers(doc[row], key[row], lo + first, lo + last + WIDTH)


def _filter(rows: DataFrame, buckets: int) -> np.ndarray:
    """The filter from its slices: a fixed number of bytes in all."""
    share = FILTER_BITS // buckets
    whole = np.zeros(FILTER_BITS // 8 + 1, np.uint8)
    for row in rows.toLocalIterator():
        slots = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=share)
        places = np.flatnonzero(slots) + row["bucket"] * share
        np.bitwise_or.at(whole, places >> 3, (np.uint8(128) >> (places & 7).astype(np.uint8)))
    return whole


def repeats(texts: DataFrame, total_bytes: int) -> DataFrame:
    """(doc_id, key, low, high): covered bytes of distinct texts (doc_id, key, text)."""
    spans = ["doc_id", "key", "low", "high"]
    buckets = max(16, -(-total_bytes // BUCKET_BYTES))
    spark = texts.sparkSession
    sent = StructType.fromDDL("bucket long, blob binary")
    sent_schema = to_arrow_schema(sent)

    def strings(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        low = np.sort(np.concatenate([np.frombuffer(b, "<u4") for b in part["blob"]]))
        twice = np.unique(low[1:][low[1:] == low[:-1]])
        share = FILTER_BITS // buckets
        bits = bits_set((twice % np.uint32(share)).astype(np.int64), buckets)
        return pd.DataFrame({"bucket": [key[0]], "bits": [bits]})

    counted = (
        texts.mapInArrow(lambda b: _strings(b, sent_schema, buckets), sent)
        .groupBy("bucket")
        .applyInPandas(strings, "bucket long, bits binary")
    )
    shared = spark.sparkContext.broadcast(_filter(stage(counted, "sample-filter"), buckets))
    ranked = stage(
        texts.mapInArrow(
            lambda b: _ranked(b, sent_schema, buckets, shared.value, SAMPLE), sent
        )
        .groupBy("bucket")
        .applyInPandas(lambda k, p: covered_by_rank(k[0], p["blob"], buckets), RANKED),
        "ranked-samples",
    )
    marks = ranked.where(F.col("kind") == MARK).select(F.col("key").alias("bucket"), "bits")
    edges = spark.sparkContext.broadcast(_filter(marks, buckets))
    shared.unpersist()
    sorted_ = (
        texts.mapInArrow(lambda b: _ranked(b, sent_schema, buckets, edges.value, EDGE), sent)
        .groupBy("bucket")
        .applyInPandas(lambda k, p: covered_by_sort(p["blob"]), COVERS)
    )
    settled = ranked.where(F.col("kind") == COVERED).select(*spans)
    lost = ranked.where(F.col("kind") == LOST).select("a", "c", "doc_id")
    waiting = ranked.where(F.col("kind") == WAITING).join(lost, ["a", "c", "doc_id"]).select(*spans)
    return settled.unionAll(waiting).unionAll(sorted_)


def _kept(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        columns = (batch.column(k) for k in ("text", "whole", "covers"))
        for text, whole, covers in zip(*columns):
            data = text.as_py().encode()
            pieces, end, removed, spans = [], 0, 0, 0
            if whole.as_py() and len(data) >= WIDTH:
                rows.append((len(data), len(data), 1, b""))
                continue
            for cover in covers.as_py() or ():
                low, high = cover["low"], cover["high"]
                if low > end or spans == 0:
                    pieces.append(data[end:low])
                    spans += 1
                    removed += high - low
                    end = high
                elif high > end:
                    removed += high - end
                    end = high
            pieces.append(data[end:])
            rows.append((len(data), removed, spans, b"".join(pieces)))
        if rows:
            size, removed, spans, kept = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(size, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.int64()),
                    pa.array(kept, pa.binary()),
                ],
                schema=schema,
            )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        text.alias("text"),
        text_key().alias("key"),
        F.unhex(F.md5(text.cast("binary"))).alias("hash"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST).cast("long")).alias("order"),
    )
    equal = stage(
        rows.groupBy("hash").agg(
            F.min("order").alias("first"),
            F.max("order").alias("last"),
            F.max(F.octet_length("text")).alias("size"),
        ),
        "equal-texts",
    )
    total = equal.agg(F.sum("size")).first()[0] or 0
    firsts = broadcast_below(equal.select("hash", "first"), 64)
    texts = (
        rows.join(firsts, (rows["hash"] == firsts["hash"]) & (rows["order"] == firsts["first"]), "left_semi")
        .where(F.octet_length("text") >= WIDTH)
        .select(F.col("order").alias("doc_id"), "key", "text")
    )
    covers = stage(
        repeats(texts, total)
        .groupBy("doc_id", "key")
        .agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("covers")),
        "covered-bytes",
    )
    covers = covers.alias("c")
    later = broadcast_below(
        stage(equal.where("last > first").select("hash", "first"), "copied-texts"), 64
    ).alias("e")
    joined = (
        rows.alias("r")
        .join(later, F.col("r.hash") == F.col("e.hash"), "left")
        .join(
            covers,
            (F.col("r.order") == F.col("c.doc_id")) & (F.col("r.key") == F.col("c.key")),
            "left",
        )
        .select(
            "r.doc_id",
            "r.text",
            F.coalesce(F.col("r.order") > F.col("e.first"), F.lit(False)).alias("whole"),
            "c.covers",
        )
    )
    struct = StructType.fromDDL(
        f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    )
    schema = to_arrow_schema(struct)
    return joined.mapInArrow(lambda b: _kept(b, schema), struct)
