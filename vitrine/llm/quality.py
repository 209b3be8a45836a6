"""Quality rules: word and repetition counts, and bands for zstandard ratios.

Repetitive text compresses to a small part of its bytes, random text to nearly all of
them.  Both ends are cut off by limits that depend on the length, since a short text
compresses worse than a long one of the same kind.  Whole texts and fixed chunks are
judged, so one bad half does not hide behind a good one; a last chunk of under half the size
counts with the one before it.  An empty table gives no rows.

Null or empty text has no words and fails the base rules.  Rows are judged one by one, so
repeated rows get equal results; other columns are left alone.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import portions

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SYMBOLS = "#*$%&|<>"
LEVEL = 3
CHUNK = 4096
# (bytes below, least ratio, greatest ratio) for zstandard level 3.
BANDS = (
    (128, 0.40, 1.60),
    (512, 0.30, 1.00),
    (2_048, 0.25, 0.85),
    (8_192, 0.20, 0.75),
    (65_536, 0.15, 0.70),
    (float("inf"), 0.10, 0.70),
)
# Share of a text's chunks outside their band from which it is rejected, in percent.
BAD_CHUNKS = 30
MIN_WORDS = 50

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"
)


def in_band(size: int, compressed: int, bands=BANDS) -> bool:
    for below, least, greatest in bands:
        if size < below:
            return least * size <= compressed <= greatest * size
    return True


def repeated_words(words: list[bytes]) -> int:
    """Words inside a three-word window that occurs twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    covered = end = 0
    for at, window in enumerate(windows):
        if seen[window] > 1:
            covered += at + 3 - max(at, end)
            end = at + 3
    return covered


def duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def measure(text: str, packer: zstandard.ZstdCompressor, bands=BANDS) -> tuple:
    data = text.encode()
    words = data.split()  # bytes split at ASCII white space only
    n_words = len(words)
    word_chars = len(text) - len(data) + sum(map(len, words))
    repeats = repeated_words(words)
    failed = n_words < MIN_WORDS or 100 * repeats > 50 * n_words
    packed = len(packer.compress(data)) if data else 0
    chunks = [data[at : at + CHUNK] for at in range(0, len(data), CHUNK)]
    if len(chunks) > 1 and len(chunks[-1]) < CHUNK // 2:
        last = chunks.pop()  # too short to say anything by itself
        chunks[-1] += last
    if len(chunks) == 1:
        bad = 0 if in_band(len(data), packed, bands) else 1
    else:
        bad = sum(not in_band(len(c), len(packer.compress(c)), bands) for c in chunks)
    good = in_band(len(data), packed, bands) and 100 * bad <= BAD_CHUNKS * len(chunks)
    return (
        n_words,
        word_chars,
        sum(map(text.count, SYMBOLS)),
        duplicate_lines(text),
        repeats,
        failed,
        not failed and good,
        packed / len(data) if data else None,
        len(chunks),
        bad,
    )


def _measured(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    for batch in portions(batches):
        found = [
            measure(text.as_py() or "", packer) for text in batch.column(batch.num_columns - 1)
        ]
        columns = [
            pa.array(column, field.type)
            for column, field in zip(zip(*found), list(schema)[batch.num_columns - 1 :])
        ]
        if found:
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + columns, schema=schema)


def judge(docs: DataFrame, *carry: str) -> DataFrame:
    """One row per document: the carried columns, the counts and the verdict."""
    names = list(carry) or ["doc_id"]
    kept = docs.select(*names, F.coalesce("text", F.lit("")).alias("text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1])
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    struct = StructType.fromDDL(f"{types}, {MEASURES}")
    schema = to_arrow_schema(struct)
    return kept.mapInArrow(lambda batches: _measured(batches, schema), struct)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    struct = docs.schema

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch in portions(batches):
            at = batch.schema.get_field_index("text")
            mask = [measure(text.as_py() or "", packer)[6] for text in batch.column(at)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(passing, struct)
