"""Token ids as a binary corpus, entropy-coded with a static range asymmetric numeral system.

Documents are encoded in ascending doc_id order.  The corpus is a folder of three tables:

``table``   one frequency for each id, shared by all blocks; the frequencies add up to 2**20.
``blocks``  independent blocks of whole documents: first token, the documents' ids and
            lengths, a CRC-32 of the token ids, and the payload.
Payload     little-endian: magic, tokens, lanes, steps between checkpoints, words; the lanes'
            states (uint64); for each checkpoint the word it starts at (uint32) and the
            states there; then the 32-bit words.

Token i of a block belongs to lane i mod lanes, so a step codes one token in every lane at
once.  Blocks need nothing of each other and decode in parallel; inside a block, decoding
can start at any checkpoint.  Spark writes the tables, so a lost task leaves no half file.

Null text is empty; each document ends with the end id, so an empty one has one token.
Null doc_ids come first; rows that share a doc_id follow in order of a hash of the text.
An empty table gives no blocks.
"""

from __future__ import annotations

import os
import sys
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vitrine.llm.common import text_key
from vitrine.sources.staging import shared_folder, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 20
LOW = np.uint64(1 << 31)
HALF = np.uint64(32)
LANES = 1024
STEPS = 128
# Tokens from which a block is closed; it ends with a whole document.
BLOCK = 1 << 18
MAGIC = b"RANS"
# Pieces of text whose ids a worker remembers, and characters that are encoded together.
REMEMBERED = 700_000
GROUP = 1 << 20


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2**SCALE; every id that occurs has one at least."""
    total = 1 << SCALE
    used = np.flatnonzero(counts)
    freq = np.zeros(len(counts), np.int64)
    if not len(used):
        return freq
    exact = counts[used] * (total / counts.sum())
    share = np.maximum(1, np.floor(exact)).astype(np.int64)
    rest = total - share.sum()
    if rest >= 0:
        order = np.argsort(share - exact, kind="stable")
        share[order[: rest % len(used)]] += 1
        share += rest // len(used)
    while rest < 0:  # too many were lifted to one: take from the largest
        order = np.argsort(-share, kind="stable")
        spare = np.minimum(share[order] - 1, np.maximum(1, share[order] // 64))
        taken = np.minimum(spare, np.maximum(0, -rest - np.concatenate([[0], np.cumsum(spare)[:-1]])))
        share[order] -= taken
        rest = total - share.sum()
    freq[used] = share
    return freq


class Table:
    """Frequencies with what encoding and decoding look up."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    freq, start = table.freq[ids], table.start[ids]
    limit = freq << np.uint64(63 - SCALE)
    scale, mask = np.uint64(SCALE), np.uint64(0xFFFFFFFF)
    chunks: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    for step in range(steps - 1, -1, -1):
        at = slice(step * lanes, min(n, (step + 1) * lanes))
        f = freq[at]
        x = state[: len(f)]
        full = x >= limit[at]
        chunks.append((x[full] & mask).astype("<u4"))
        x = np.where(full, x >> HALF, x)
        div = x // f
        state[: len(f)] = (div << scale) + (x - div * f) + start[at]
        if step % STEPS == 0 and step:
            marks.append((step, state.copy()))
    chunks.reverse()
    marks.reverse()
    sizes = np.cumsum([0] + [len(c) for c in chunks])
    parts = [
        MAGIC,
        np.array([n, lanes, STEPS, sizes[-1]], "<u4").tobytes(),
        state.astype("<u8").tobytes(),
        *(
            np.array([sizes[step]], "<u4").tobytes() + states.astype("<u8").tobytes()
            for step, states in marks
        ),
        np.concatenate(chunks).tobytes() if chunks else b"",
    ]
    return b"".join(parts)


def decode(payload: bytes, table: Table, checkpoint: int = 0) -> np.ndarray:
    """The block's ids from the checkpoint on; checkpoint 0 is the start."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block")
    n, lanes, every, n_words = (int(v) for v in np.frombuffer(payload, "<u4", 4, 4))
    steps = -(-n // lanes)
    n_marks = max(0, (steps - 1) // every)
    base = 20 + 8 * lanes
    words = np.frombuffer(payload, "<u4", n_words, base + n_marks * (4 + 8 * lanes)).astype(np.uint64)
    if checkpoint:
        mark = base + (checkpoint - 1) * (4 + 8 * lanes)
        at = int(np.frombuffer(payload, "<u4", 1, mark)[0])
        state = np.frombuffer(payload, "<u8", lanes, mark + 4).astype(np.uint64)
    else:
        at, state = 0, np.frombuffer(payload, "<u8", lanes, 20).astype(np.uint64)
    first = checkpoint * every
    out = np.empty(n - first * lanes, np.uint32)
    mask, scale = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    for step in range(first, steps):
        k = min(lanes, n - step * lanes)
        x = state[:k]
        slot = x & mask
        symbol = table.symbol[slot]
        place = (step - first) * lanes
        out[place : place + k] = symbol
        x = table.freq[symbol] * (x >> scale) + slot - table.start[symbol]
        short = np.flatnonzero(x < LOW)
        x[short] = (x[short] << HALF) | words[at : at + len(short)]
        at += len(short)
        state[:k] = x
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


STEP = 0xD6E8FEB86659FD93
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
MARK = "\x01"
LETTER, STOP = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
STOP[list(b".,;:!?|")] = True


class Encoder:
    """Ids of texts, pieces between spaces and newlines remembered across the worker's tasks.

    No token spans a space or newline, or a letter and a stop after it, so a text's ids are
    those of its pieces in order.  Equal pieces of many texts are looked up once, and where
    the tokenizer ignores case so does the lookup of ASCII letters, but for those that a mark
    may follow: it composes before it lower-cases.  New pieces are encoded many at a time:
    words of letters are told apart by their word ends, other pieces by a piece of known id
    between them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        # This module travels by value and is made anew for each task; the library stays.
        kept = tokenizers.__dict__.setdefault("remembered_pieces", {})
        if path not in kept:
            tokenizer = tokenizers.Tokenizer.from_file(path)
            vocabulary = tokenizer.get_vocab()
            ends = np.zeros(max(vocabulary.values()) + 1, bool)
            ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
            kept[path] = tokenizer, [{}, {}], ends
        self.tokenizer, self.generations, self.ends = kept[path]
        self.mark_ids = self._ids(MARK)
        letters = "abcdefghijklmnopqrstuvwxyz"
        self.caseless = all(
            (self._ids(f"{c}x{c}") == self._ids(f"{c}x{c}".upper())).all()
            if len(self._ids(f"{c}x{c}")) == len(self._ids(f"{c}x{c}".upper()))
            else False
            for c in letters
        )

    def _ids(self, text: str) -> np.ndarray:
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found[0].ids, "<u2")

    def _learn(self, new: list[bytes]) -> None:
        words: list[bytes] = []
        others: list[bytes] = []
        for piece in new:
            text = piece.decode()
            # In lower case, as the tokenizer sees it, some letters become letter and mark.
            (words if text.isalpha() and text.lower().isalpha() else others).append(piece)
        for low in range(0, len(words), 500):
            some = words[low : low + 500]
            ids = self._ids(b" ".join(some).decode())
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some) or cuts[-1] != len(ids):
                others += some  # a vocabulary without word ends
                continue
            for piece, a, b in zip(some, np.append(0, cuts[:-1]), cuts):
                self.pieces[piece] = ids[a:b].tobytes()
        mark = MARK.encode()
        single = [p for p in others if mark in p or len(self.mark_ids) != 1]
        for piece in single:
            self.pieces[piece] = self._ids(piece.decode()).tobytes()
        others = [p for p in others if p not in self.pieces] if single else others
        for low in range(0, len(others), 500):
            some = others[low : low + 500]
            ids = self._ids(f" {MARK} ".join(p.decode() for p in some))
            cuts = np.flatnonzero(ids == self.mark_ids[0])
            for piece, a, b in zip(some, np.append(0, cuts + 1), np.append(cuts, len(ids))):
                self.pieces[piece] = ids[a:b].tobytes()

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        data = [t.encode() for t in texts]
        joined = b"\n".join([*data, b""])
        raw = np.frombuffer(joined, np.uint8)
        if self.caseless:
            # Special tokens are told by case.
            plain = np.repeat([b"<|" not in d for d in data], [len(d) + 1 for d in data])
            upper = (raw >= 65) & (raw <= 90) & np.append(raw[1:] < 128, True)
            raw = np.where(upper & plain, raw | np.uint8(32), raw)
            joined = raw.tobytes()
        blank = (raw == 32) | (raw == 10)
        first = np.flatnonzero(~blank & np.append(True, blank[:-1]))
        after = np.flatnonzero(blank & np.append(False, ~blank[:-1]))
        # A stop after a letter at the end of a piece is a piece of its own.
        cut = STOP[raw[after - 1]] & (after - first > 1) & LETTER[raw[np.maximum(after - 2, 0)]]
        place = np.arange(len(first)) + np.cumsum(cut) - cut
        begins, stops = (np.empty(len(first) + int(cut.sum()), np.int64) for _ in range(2))
        begins[place], stops[place] = first, after - cut
        begins[place[cut] + 1], stops[place[cut] + 1] = after[cut] - 1, after[cut]
        first, after = begins, stops
        power = np.cumprod(np.full(len(raw), STEP, np.uint64))
        inverse = np.cumprod(np.full(len(raw), pow(STEP, -1, 1 << 64), np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[raw] * power)])
        hashes = mix((sums[after] - sums[first]) * inverse[first] ^ (after - first).astype(np.uint64))
        _, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        spans = zip(first[example].tolist(), after[example].tolist())
        distinct = [joined[a:b] for a, b in spans]
        # Pieces in use move to the young generation; those that are not go with the old one.
        self.pieces, old = self.generations
        found = list(map(self.pieces.get, distinct))
        new = []
        for at, ids in enumerate(found):
            if ids is None:
                piece = distinct[at]
                ids = old.get(piece)
                if ids is None:
                    new.append(piece)
                else:
                    self.pieces[piece] = found[at] = ids
        if new:
            self._learn(new)
            found = [self.pieces[p] if ids is None else ids for p, ids in zip(distinct, found)]
        if len(self.pieces) > REMEMBERED // 2:
            self.generations[:] = {}, self.pieces
        flat = np.frombuffer(b"".join(found), "<u2")
        sizes = np.array([len(x) // 2 for x in found], np.int64)
        offsets = np.cumsum(sizes) - sizes
        length = sizes[which]
        starts = np.cumsum(length) - length
        ids = flat[np.repeat(offsets[which] - starts, length) + np.arange(length.sum())]
        ends = np.cumsum([len(d) + 1 for d in data])
        edges = np.searchsorted(first, np.append(0, ends))
        bounds = np.append(starts, len(ids))[edges]
        tail = np.array([end], "<u2").tobytes()
        return [ids[a:b].tobytes() + tail for a, b in zip(bounds[:-1], bounds[1:])]


def _tokenized(batches: Iterator[pa.RecordBatch], schema: pa.Schema, path: str, end: int):
    """(doc_id, part, at, ids): at counts the tokens of the part before the document."""
    encoder, at = Encoder(path), 0
    for whole in batches:
        low = 0
        while low < whole.num_rows:
            texts = whole.column("text")[low : low + 512].to_pylist()
            upto = int(np.searchsorted(np.cumsum([len(t) for t in texts]), GROUP))
            batch = whole.slice(low, max(1, min(upto, len(texts))))
            low += batch.num_rows
            ids = encoder.encode(texts[: batch.num_rows], end)
            sizes = np.array([len(x) // 2 for x in ids], np.int64)
            starts = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("part"),
                    pa.array(starts),
                    pa.array(sizes.astype(np.int32)),
                    pa.array(ids, pa.binary()),
                ],
                schema=schema,
            )


def _counted(batches: Iterator[pa.RecordBatch], schema: pa.Schema):
    counts = np.zeros(1 << 16, np.int64)
    for batch in batches:
        ids = b"".join(batch.column("ids").to_pylist())
        counts += np.bincount(np.frombuffer(ids, "<u2"), minlength=1 << 16)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], schema=schema)


def _blocks(batches: Iterator[pa.RecordBatch], schema: pa.Schema, freq: np.ndarray):
    table = Table(freq)
    docs: list = []
    parts: list[np.ndarray] = []
    first = size = 0

    def close() -> pa.RecordBatch:
        ids = np.concatenate(parts)
        row = [
            [first],
            [size],
            [docs],
            [[len(p) for p in parts]],
            [zlib.crc32(ids.astype("<u4").tobytes())],
            [encode(ids, table)],
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema
        )

    for batch in batches:
        starts = batch.column("start").to_pylist()
        for doc_id, start, ids in zip(batch.column("doc_id").to_pylist(), starts, batch.column("ids")):
            if parts and (size >= BLOCK or start != first + size):
                yield close()
                docs, parts, size = [], [], 0
            if not parts:
                first = start
            docs.append(doc_id)
            parts.append(np.frombuffer(ids.as_buffer(), "<u2"))
            size += len(parts[-1])
    if parts:
        yield close()


def _decoded(batches: Iterator[pa.RecordBatch], schema: pa.Schema, freq: np.ndarray):
    table = Table(freq)
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode(row["payload"], table).astype("<u4")
            if zlib.crc32(ids.tobytes()) != row["crc32"]:
                raise ValueError(f"block at token {row['start']} is damaged")
            ends = np.cumsum(row["lengths"])
            begins = ends - row["lengths"]
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends)]
            columns = [row["doc_ids"], begins + row["start"], row["lengths"], sums]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(columns, schema)], schema=schema
            )


def _map(frame: DataFrame, function, ddl: str, *more) -> DataFrame:
    struct = StructType.fromDDL(ddl)
    schema = to_arrow_schema(struct)
    return frame.mapInArrow(lambda batches: function(batches, schema, *more), struct)


def write_corpus(docs: DataFrame, path: str, end: int = 2, folder: str | None = None) -> str:
    """Encode the documents with the tokenizer file and write the corpus; returns its folder."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens/{uuid.uuid4().hex}"
    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = (
        docs.select("doc_id", text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), "text_key")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text_key")
        .select("doc_id", F.spark_partition_id().cast("long").alias("part"), "text")
    )
    tokens = stage(
        _map(ordered, _tokenized, f"doc_id {kind}, part long, at long, n int, ids binary", path, end),
        "token-ids",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = tokens.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each write task
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    counts = _map(tokens.select("ids"), _counted, "id int, count long")
    # As many rows as the vocabulary has ids come to the driver.
    seen = counts.groupBy("id").agg(F.sum("count").alias("count")).toPandas()
    total = np.zeros(1 << 16, np.int64)
    total[seen["id"].to_numpy(np.int64)] = seen["count"].to_numpy(np.int64)
    freq = scaled(total)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq) if f], "id int, freq long").write.parquet(
        f"{folder}/table"
    )
    placed = tokens.join(F.broadcast(parts), "part").select(
        "doc_id", (F.col("offset") + F.col("at")).alias("start"), "ids"
    )
    _map(
        placed,
        _blocks,
        f"start long, n_tokens long, doc_ids array<{kind}>, lengths array<int>, crc32 long, payload binary",
        freq,
    ).write.option("compression", "none").parquet(f"{folder}/blocks")
    return folder


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone."""
    freq = np.zeros(1 << 16, np.int64)
    for row in spark.read.parquet(f"{folder}/table").toLocalIterator():
        freq[row["id"]] = row["freq"]
    blocks = spark.read.parquet(f"{folder}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return _map(
        blocks, _decoded, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long", freq
    )
