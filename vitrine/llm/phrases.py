"""Phrases of two to four words that occur together, by partitioned frequent-phrase mining.

Text becomes blocks of word numbers once: ``blocks`` holds, for up to ``BLOCK`` words of one
language, the distinct words with their hashes and an array that says which word stands where;
breaks between pieces of text are holes.  A shard is the blocks of every ``SHARDS``-th task of
that step, so there are as many at every size of the corpus and a shard is mined by many
tasks.  For each length of phrase:

1. Every shard is mined completely at its share of the support: with n words of the
   language's N, a phrase is locally frequent from ceil(support * n / N) on.  A phrase that is
   locally frequent in no shard is below the support.
2. The union of the locally frequent phrases are the candidates, but for those whose counts,
   with all that other shards may have of them, stay under the support.
3. All candidates are counted in all shards, by their strings, and those below the support go.

Step 1 skips phrases with an infrequent part and knows phrases by ``HASH_BITS`` bits of their
hashes; steps 1 and 3 look hashes up in bitmaps.  A hash or a bit that two phrases share lets
one through, which costs rows and changes no result, since step 3 counts exactly whatever it is
given.  Where candidates are more than ``BITS`` can tell apart, step 3 runs once for each slice
of the hashes.

Most of what is on disk are the shuffled counts of steps 1 and 3.  In step 1 language, shard and
hash are one number; in step 3 strings travel without hashes, which are made again for the few
that are frequent.

Null text is empty, null lang is 'und', an empty lang stays as it is.  Rows count as often as
they occur.  Ties in score go to the more frequent phrase, then to the lower in UTF-8 order.
Empty tables, and languages without candidates, give no rows.  Other columns are not read.
"""

from __future__ import annotations

import ctypes
import re
import sys
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import map_batches, portions, record_batch
from vitrine.sources.staging import session_folder, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LONGEST = 4
SUPPORT = 30
KEPT = 2000
SHARDS = 5
BLOCK = 1 << 17
# Words of a shard that a task counts at a time.
PART = 1_500_000
# Distinct words that a task counts before it sends them on.
HELD = 250_000
# Bits of a bitmap at most, and bits for each hash in it.
BITS = 1 << 27
BITS_EACH = 16
# Bits of a mined phrase's hash, fewer where languages and shards need them.
HASH_BITS = 40

# A word, or a break between pieces.
WORD = re.compile("[.,;:!?\\x0A-\\x0D]|[^\\x20\\x09.,;:!?\\x0A-\\x0D]+")
BREAKS = [*".,;:!?\n\x0b\x0c\r"]
END = np.array([-1], np.int32)
STEP = np.uint64(0x9E3779B97F4A7C15)


def _blocks(batches: Iterator[pa.RecordBatch], schema: pa.Schema):
    """Rows of blocks (lang, shard, words, hashes, n, places), and of counted words (lang,
    word, h, count)."""
    shard = TaskContext.get().partitionId() % SHARDS
    started: dict[str, tuple[dict[str, int], list[np.ndarray]]] = {}
    counts: dict[str, Counter] = {}

    def close(lang: str):
        numbers, parts = started.pop(lang)
        places = np.concatenate(parts)
        words = list(numbers)[len(BREAKS) :]
        if not words:
            return
        held = np.bincount(places[places >= 0], minlength=len(words))
        counts.setdefault(lang, Counter()).update(dict(zip(words, held.tolist())))
        hashes = word_hashes(lang, words).astype("<u8").tobytes()
        row = [lang, shard, " ".join(words), hashes, int(held.sum()), places.astype("<i4").tobytes(), None, None, None]
        yield record_batch([[x] for x in row], schema)

    def send():
        for lang, number in counts.items():
            pairs = iter(number.items())
            while some := list(islice(pairs, 50_000)):
                words, count = zip(*some)
                none = [None] * len(some)
                yield record_batch(
                    [[lang] * len(some), none, none, none, none, none, words, word_hashes(lang, words).view(np.int64), count],
                    schema,
                )
        counts.clear()

    for batch in portions(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if lang not in started:  # breaks are -1, words are numbered as they come
                started[lang] = dict.fromkeys(BREAKS, -1), []
            numbers, parts = started[lang]
            # Only A to Z: bytes outside ASCII stay as they are.
            text = text.encode().lower().decode()
            matches = iter(WORD.findall(text)) if len(text) <= BLOCK else (m[0] for m in WORD.finditer(text))
            while some := list(islice(matches, BLOCK)):
                for word in set(some).difference(numbers):
                    numbers[word] = len(numbers) - len(BREAKS)
                parts.append(np.fromiter(map(numbers.get, some), np.int32, len(some)))
            parts.append(END)
            if len(parts) > BLOCK or sum(map(len, parts)) >= BLOCK:
                yield from close(lang)
        if sum(map(len, counts.values())) > HELD:
            yield from send()
    for lang in list(started):
        yield from close(lang)
    yield from send()
    release()


def release() -> None:
    """Give freed memory back: workers stay for the next stage, which needs it elsewhere."""
    library = ctypes.CDLL(None)
    if hasattr(library, "malloc_trim"):
        library.malloc_trim(0)


def word_hashes(lang: str, words) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.array([xxhash.xxh3_64_intdigest(w.encode(), seed) for w in words], np.uint64)


def phrase_hashes(hashes: np.ndarray, inside: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each place on, and whether all of them are words of one piece."""
    n = max(0, len(hashes) - k + 1)
    h, ok = hashes[:n], inside[:n]
    for j in range(1, k):
        h = h * STEP + hashes[j : j + n]
        h ^= h >> np.uint64(31)
        ok = ok & inside[j : j + n]
    return h, ok


def listed(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def _parts(batches: Iterator[pa.RecordBatch], with_words: bool = False):
    """(lang, shard, words, places, hashes, inside): what the task holds of a shard, up to PART
    words at a time."""
    held: dict[tuple[str, int], list[tuple]] = {}

    def joined(key: tuple[str, int]):
        blocks = held.pop(key)
        words = [w for block, *_ in blocks for w in block.split(" ")] if with_words else None
        own = word_hashes(key[0], words) if with_words else np.concatenate([h for _, h, _ in blocks])
        places, first = [], 0
        for block, h, p in blocks:
            places.append(np.where(p < 0, np.int32(-1), p + np.int32(first)))
            first += block.count(" ") + 1 if with_words else len(h)
        places = np.concatenate(places)
        inside = places >= 0
        return *key, words, places, np.where(inside, own[places], np.uint64(0)), inside

    for batch in portions(batches, 8):
        for row in batch.to_pylist():
            key = row["lang"], row["shard"]
            blocks = held.setdefault(key, [])
            hashes = None if with_words else np.frombuffer(row["hashes"], "<u8")
            blocks.append((row.get("words"), hashes, np.frombuffer(row["places"], "<i4")))
            if sum(len(places) for *_, places in blocks) >= PART:
                blocks = None
                yield joined(key)
                release()
    for key in list(held):
        yield joined(key)
        release()


def _mined(
    batches: Iterator[pa.RecordBatch], schema: pa.Schema, k: int, parts: np.ndarray,
    numbers: dict[tuple[str, int], int], bits: int,
):
    """(key, count) of the phrases of k words whose parts are frequent; ``key`` is the number of
    the language and shard, and ``bits`` of the hash below it."""
    for lang, shard, _, _, hashes, inside in _parts(batches):
        shorter, ok = phrase_hashes(hashes, inside, k - 1)
        ok = ok & listed(parts, shorter)
        h, whole = phrase_hashes(hashes, inside, k)
        h = np.sort(h[whole & ok[:-1] & ok[1:]] & np.uint64((1 << bits) - 1))
        if not len(h):
            continue
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        count = np.diff(np.append(starts, len(h)))
        key = h[starts].view(np.int64) | np.int64(numbers[lang, shard] << bits)
        for low in range(0, len(key), 100_000):
            some = pa.array(key[low : low + 100_000])
            counts = pa.array(count[low : low + 100_000].astype(np.int32))
            yield pa.RecordBatch.from_arrays([some, counts], schema=schema)


def _recounted(
    batches: Iterator[pa.RecordBatch], schema: pa.Schema, k: int, candidates: np.ndarray, bits: int, slices: int,
    which: int,
):
    """(lang, phrase, count) for the candidates of a slice in each shard."""
    for lang, _, words, places, hashes, inside in _parts(batches, True):
        h, ok = phrase_hashes(hashes, inside, k)
        mined = h & np.uint64((1 << bits) - 1)
        ok = ok & listed(candidates, mined)
        if slices > 1:
            ok &= mined % np.uint64(slices) == which
        at = np.flatnonzero(ok)
        at = at[np.argsort(h[at], kind="stable")]
        if not len(at):
            continue
        new = np.zeros(len(at), bool)
        new[0] = True
        for j in range(k):  # phrases under one hash are rows of their own
            new[1:] |= places_differ(hashes, at, j)
        starts = np.flatnonzero(new)
        count = np.diff(np.append(starts, len(at)))
        first = at[starts]
        for low in range(0, len(first), 50_000):
            some = first[low : low + 50_000]
            chosen = np.stack([places[some + j] for j in range(k)], 1).tolist()
            phrases = [" ".join([words[i] for i in row]) for row in chosen]
            yield record_batch([[lang] * len(some), phrases, count[low : low + 50_000]], schema)


def places_differ(hashes: np.ndarray, at: np.ndarray, j: int) -> np.ndarray:
    return hashes[at[1:] + j] != hashes[at[:-1] + j]


def _hashed(batches: Iterator[pa.RecordBatch], schema: pa.Schema, k: int):
    """Counted phrases (lang, phrase, f) of k words with their hashes: (lang, phrase, k, h, f)."""
    for batch in portions(batches, 50_000):
        langs = np.array(batch.column("lang").to_pylist(), object)
        phrases = np.array(batch.column("phrase").to_pylist(), object)
        f = batch.column("f").to_numpy()
        for lang in set(langs.tolist()):
            own = langs == lang
            words = " ".join(phrases[own]).split(" ")
            h, _ = phrase_hashes(word_hashes(lang, words), np.ones(len(words), bool), k)
            n = int(own.sum())
            yield record_batch([[lang] * n, phrases[own].tolist(), [k] * n, h[::k].view(np.int64), f[own]], schema)


def bitmap(table: DataFrame, n: int) -> np.ndarray:
    """Bits of the hashes ``h``; at most BITS / 64 rows come to the driver."""
    bits = min(BITS, max(1 << 12, 1 << (BITS_EACH * n).bit_length()))
    bit = F.col("h").bitwiseAND(F.lit(bits - 1))
    slots = table.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("slot")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("held")
    ).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[slots.column("slot").to_numpy()] = slots.column("held").to_numpy().view(np.uint64)
    return out


def frequent_phrases(docs: DataFrame, support: int = SUPPORT) -> tuple[DataFrame, dict[str, int]]:
    """(lang, phrase, k, h, f) of all phrases of 1 to LONGEST words that occur ``support`` times,
    and the number of words of each language."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    ddl = "lang string, shard int, words string, hashes binary, n long, places binary, word string, h long, count long"
    folder = f"{session_folder(spark)}/blocks-{uuid.uuid4().hex}"
    # Small row groups: a row is a block, and readers take a row group at a time.
    map_batches(texts, _blocks, ddl).write.option("compression", "zstd").option(
        "parquet.block.size", 8 << 20
    ).parquet(folder)
    table = spark.read.schema(ddl).parquet(folder)
    blocks = table.where("word is null").select("lang", "shard", "words", "hashes", "places")
    sizes = table.where("n is not null").groupBy("lang", "shard").agg(F.sum("n").alias("n")).collect()
    totals: dict[str, int] = {}
    for row in sizes:
        totals[row["lang"]] = totals.get(row["lang"], 0) + row["n"]
    # A row for each language and shard.
    numbers = {(r["lang"], r["shard"]): number for number, r in enumerate(sizes)}
    bits = min(HASH_BITS, 63 - len(sizes).bit_length())
    least = spark.createDataFrame(
        [(number, r["lang"], -(-support * r["n"] // totals[r["lang"]])) for number, r in enumerate(sizes)],
        "number long, lang string, least long",
    )
    untold = least.groupBy("lang").agg(F.sum(F.col("least") - 1).alias("untold"))
    found = stage(
        table.where("word is not null").groupBy("lang", "word").agg(F.sum("count").alias("f"), F.first("h").alias("h"))
        .where(F.col("f") >= support).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("k"), "h", "f"),
        "frequent-words",
    )
    lengths = [found]
    for k in range(2, LONGEST + 1):
        n = found.count()
        if not n:
            break
        mined = map_batches(
            blocks.select("lang", "shard", "hashes", "places"), _mined, "key long, count int", k, bitmap(found, n), numbers, bits
        )
        local = mined.groupBy("key").agg(F.sum("count").alias("count")).select(
            F.shiftright("key", bits).alias("number"), F.col("key").bitwiseAND(F.lit((1 << bits) - 1)).alias("h"), "count"
        )
        # What a shard that does not name a phrase may have of it is one less than its share.
        named = local.join(F.broadcast(least), "number").where("count >= least").groupBy("lang", "h").agg(
            F.sum("count").alias("named"), F.sum(F.col("least") - 1).alias("told")
        )
        candidates = stage(
            named.join(F.broadcast(untold), "lang").where(F.col("named") + F.col("untold") - F.col("told") >= support)
            .select("lang", "h"),
            "candidates",
        )
        n = candidates.count()
        slices = max(1, -(-n * BITS_EACH // (2 * BITS)))
        counted = None
        for which in range(slices):
            own = candidates.where(F.expr(f"pmod(h, {slices}) = {which}"))
            part = map_batches(
                blocks.select("lang", "shard", "words", "places"), _recounted, "lang string, phrase string, count long",
                k, bitmap(own, -(-n // slices)), bits, slices, which,
            )
            counted = part if counted is None else counted.unionByName(part)
        found = stage(
            map_batches(
                counted.groupBy("lang", "phrase").agg(F.sum("count").alias("f")).where(F.col("f") >= support),
                _hashed, "lang string, phrase string, k int, h long, f long", k,
            ),
            "frequent-phrases",
        )
        lengths.append(found)
    return reduce(DataFrame.unionByName, lengths), totals


def scored(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, score): every phrase at its lowest-scoring cut."""
    cuts = frequent.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.expr("explode(sequence(1, k - 1))").alias("at"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', at)"))
    cuts = cuts.withColumn("right", F.expr("substring(phrase, char_length(left) + 2)"))
    for side, name in (("left", "l"), ("right", "r")):
        part = frequent.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
        cuts = cuts.join(part, ["lang", side])
    score = F.expr("cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div cast(l + r as decimal(20,0))")
    lowest = F.min(F.struct(score.alias("score"), "at", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "phrase", "k", "a").agg(lowest).select(
        "lang", "phrase", "k", "a", "cut.l", "cut.r", "cut.score"
    )


def without_parts(phrases: DataFrame, share: int = 80) -> DataFrame:
    """Phrases (lang, phrase, k, a) but those that mostly occur inside one longer phrase."""
    inner = F.expr(
        "explode(flatten(transform(sequence(2, k - 1), n -> transform(sequence(1, k - n + 1),"
        " s -> array_join(slice(split(phrase, ' '), s, n), ' ')))))"
    )
    longest = phrases.where("k > 2").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(
        F.max("a").alias("longer")
    )
    return phrases.join(longest, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))
    ).drop("longer")


def collocations(docs: DataFrame, support: int = SUPPORT, most: int = KEPT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``most`` phrases of each language."""
    frequent, totals = frequent_phrases(docs, support)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = without_parts(scored(frequent)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    languages = docs.sparkSession.createDataFrame(list(totals.items()), "lang string, n long")
    return ranked.join(F.broadcast(languages), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
