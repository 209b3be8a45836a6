"""Documents packed into sequences of a fixed width by online best fit with few open bins.

A document longer than a sequence is cut into full pieces; what does not fill one is its
first piece.  Each map task encodes its documents and places pieces as they come: into the
open sequence whose free space fits tightest, or into a new one.  Open sequences stand under
their free space, and a bitset of the spaces in use finds the tightest in one step.  At most
``OPEN`` are open: before another opens, the fullest closes.

What tasks leave open is packed again, by the same rule for ``FAN`` tasks at a time, and so
on until one group is left.  A group holds what FAN * OPEN sequences hold, in at most 16
parts each, so no task grows with the corpus.  The last OPEN sequences are packed once more
with the longest parts first.

Null text is empty; each document ends with the end id, so an empty one has one token.  Rows
that share a doc_id are documents of their own, null doc_ids too.  An empty table gives no
pieces.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import broadcast_below, map_batches, portions, record_batch
from vitrine.sources.staging import session_folder, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 1024
# Sequences that a task holds open, and tasks whose open sequences are packed together.
OPEN = 512
FAN = 16
# How byte-level BPE of this kind splits a text before it merges; a fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Longer runs of white space are too deep for the fast encoder's pattern.
LONG_SPACE = re.compile(r"\s{1000}")


class Encoder:
    """Ids of texts, as the tokenizer file gives them.

    Where the file is plain byte-level BPE whose merges stand in order of their ids, the
    same merges run in tiktoken, some four times as fast; texts with the string of an added
    token or very long white space, and other files, go through tokenizers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        import tokenizers

        # This module travels by value and is made anew for each task; the library stays.
        kept = tokenizers.__dict__.setdefault("read_by_packing", {})
        if path not in kept:
            tokenizer = tokenizers.Tokenizer.from_file(path)
            added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
            ranks = self._ranks(json.loads(tokenizer.to_str()), set(added))
            fast = ranks and tiktoken.Encoding(
                "file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}
            )
            kept[path] = tokenizer, added, fast
        self.tokenizer, self.added, self.fast = kept[path]

    @staticmethod
    def _ranks(parts: dict, added: set[str]) -> dict[bytes, int] | None:
        model, split = parts["model"], parts["pre_tokenizer"] or {}
        plain = (
            model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex")
            and not split["add_prefix_space"] and not parts["normalizer"] and not model["dropout"]
            and not model["ignore_merges"] and not model["continuing_subword_prefix"]
        )
        if not plain:
            return None
        # Byte-level files write bytes without a visible character as the characters from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocabulary = {w: i for w, i in model["vocab"].items() if w not in added}
        merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged) or len(vocabulary) != 256 + len(merged):
            return None
        return {bytes(byte[c] for c in word): i for word, i in vocabulary.items()}

    def encode(self, text: str) -> list[int]:
        if not self.fast or any(a in text for a in self.added) or LONG_SPACE.search(text):
            return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return self.fast.encode_ordinary(text)


class Bins:
    """Open bins under their free space; bit ``s`` of ``spaces`` is set where one has s left."""

    def __init__(self, width: int, most_open: int):
        self.width, self.most_open = width, most_open
        self.at: dict[int, list[int]] = {}
        self.spaces = self.n_open = self.n = 0

    def _take(self, space: int) -> int:
        stack = self.at[space]
        found = stack.pop()
        if not stack:
            del self.at[space]
            self.spaces &= ~(1 << space)
        self.n_open -= 1
        return found

    def close(self) -> int:
        """Close the fullest open bin."""
        return self._take((self.spaces & -self.spaces).bit_length() - 1)

    def place(self, length: int) -> tuple[int, int, int | None]:
        """Bin and offset for a piece of this length, and the bin that closed, if one did."""
        closed = None
        fits = self.spaces >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            found = self._take(space)
        else:
            if self.n_open == self.most_open:
                closed = self.close()
            found, space = self.n, self.width
            self.n += 1
        if space > length:
            self.at.setdefault(space - length, []).append(found)
            self.spaces |= 1 << (space - length)
            self.n_open += 1
        elif fits:
            closed = found
        return found, self.width - space, closed

    def left(self) -> set[int]:
        """The bins still open."""
        return {found for stack in self.at.values() for found in stack}


def cuts(n: int, width: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    first = n % width or width
    return [(0, first)] + [(at, width) for at in range(first, n, width)]


def _packed(batches: Iterator[pa.RecordBatch], schema: pa.Schema, path: str, end: int, width: int, most_open: int):
    """The task's pieces with their places; then, under piece -1, what is in open bins.

    Short neighbours in a bin count as one, so a bin has 16 such rows at most.
    """
    encoder, bins = Encoder(path), Bins(width, most_open)
    part = TaskContext.get().partitionId() << 32
    inside: dict[int, list[list[int]]] = {}
    for batch in portions(batches):
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids = np.array([*encoder.encode(text), end], "<u4").tobytes()
            for piece, (start, length) in enumerate(cuts(len(ids) // 4, width)):
                found, offset, closed = bins.place(length)
                rows.append((doc_id, piece, start, length, ids[4 * start : 4 * (start + length)], part + found, offset))
                if length < width:
                    chunks = inside.setdefault(found, [])
                    if chunks and 16 * min(length, chunks[-1][1]) < width:
                        chunks[-1][1] += length
                    else:
                        chunks.append([offset, length])
                inside.pop(closed, None)
        if rows:
            yield record_batch(list(zip(*rows)), schema)
    rows = [(None, -1, 0, n, None, part + b, at) for b, chunks in inside.items() for at, n in chunks]
    if rows:
        yield record_batch(list(zip(*rows)), schema)


def _repacked(table: pa.Table, width: int, most_open: int, name: int, last: bool) -> pa.Table:
    """What a group has in open bins, packed anew: target, place, and whether that is open still."""
    bins = Bins(width, most_open)
    keys = list(zip(*(table.column(c).to_pylist() for c in ("bin", "at", "length"))))
    if last:  # these fit in the open bins, so the longest may come first
        keys.sort(key=lambda k: (-k[2], k))
    else:
        keys.sort(key=lambda k: (hash(k[:2]), k))
    first = min(k[0] for k in keys) >> 32 << 32
    placed = [bins.place(length)[:2] for _, _, length in keys]
    left = set() if last else bins.left()
    rows = [(*k, first + name + found, place, found in left) for k, (found, place) in zip(keys, placed)]
    types = [pa.int64()] * 5 + [pa.bool_()]
    names = ["bin", "at", "length", "target", "place", "open"]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _repacking(*settings):
    return lambda table: _repacked(table, *settings)


def _moves(opened: DataFrame, width: int, most_open: int) -> DataFrame:
    """(bin, at, length, target, place): where what stood at ``at`` of an open bin goes."""
    parts = (opened.agg(F.max(F.shiftright("bin", 32))).first()[0] or 0) + 1
    moves, span, turn = None, 1, 0
    while moves is None or span < parts * FAN:
        span, turn = span * FAN, turn + 1
        last = span >= parts * FAN
        group = F.floor(F.shiftright("bin", 32) / F.lit(span))
        step = stage(
            opened.select("bin", "at", "length", group.alias("group")).groupBy("group").applyInArrow(
                _repacking(width, most_open, turn << 28, last),
                "bin long, at long, length long, target long, place long, open boolean",
            ),
            "packed-again",
        )
        settled = step.where("not open")
        moves = settled if moves is None else moves.unionByName(settled)
        opened = step.where("open")
    return moves


def pack(
    docs: DataFrame, path: str, end: int = 2, width: int = WIDTH, most_open: int = OPEN
) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids, sequence_id, offset.

    ``ids`` are little-endian 32-bit; the tokenizer file must be at ``path`` on every node.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, piece int, start long, length long, ids binary, bin long, at long"
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    folder = f"{session_folder(spark)}/packed-{uuid.uuid4().hex}"
    # Written once: where a piece stands depends on the rows that its task read.
    map_batches(texts, _packed, ddl, path, end, width, most_open).write.option("compression", "zstd").parquet(folder)
    placed = spark.read.schema(ddl).parquet(folder)
    pieces = placed.where("piece >= 0")
    moves = _moves(placed.where("piece < 0").select("bin", "at", "length"), width, most_open)
    moves = moves.select(
        F.col("bin").alias("from"), F.col("at").alias("low"), (F.col("at") + F.col("length")).alias("high"),
        "target", "place",
    )
    inside = (F.col("bin") == F.col("from")) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))
    return pieces.join(broadcast_below(moves, 40), inside, "left").select(
        "doc_id", "piece", "start", "length", "ids",
        F.coalesce("target", "bin").alias("sequence_id"),
        F.coalesce(F.col("place") + F.col("at") - F.col("low"), F.col("at")).alias("offset"),
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids, and the documents' doc_ids."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return pieces.groupBy("sequence_id").agg(inside.alias("inside"), F.sum("length").alias("n_tokens")).select(
        "sequence_id", "n_tokens",
        F.expr("aggregate(inside, cast('' as binary), (all, x) -> concat(all, x.ids))").alias("ids"),
        F.col("inside.doc_id").alias("doc_ids"),
    )
