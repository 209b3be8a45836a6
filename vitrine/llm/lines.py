"""Line deduplication over overlapping windows of three lines.

A window is three consecutive lines of a text, known by two 64-bit hashes.  Of all equal
windows in the corpus the first by (doc_id, text, position) stays; the lines that the later
ones cover, merged, are removed.  So a repeated passage of three lines or more goes as a
whole, and a single common line stays.

Null and empty texts have no lines.  Texts under three lines have no window and stay whole.
A null doc_id sorts first.  Rows alike in doc_id and text are one document: neither is later
than the other, and both get the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import broadcast_below, let, text_key
from vitrine.sources.staging import stage

WINDOW = 3


def split_lines(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(text, "\n")
    )


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, at, a, b): the windows and their hashes."""

    def hashed(lines: Column) -> Column:
        return let(
            F.struct(
                F.transform(lines, lambda x: F.xxhash64(x)).alias("a"),
                F.transform(lines, lambda x: F.xxhash64(F.lit("second"), x)).alias("b"),
            ),
            lambda h: F.transform(
                F.sequence(F.lit(0), F.size(lines) - WINDOW),
                lambda i: F.struct(
                    F.xxhash64(*[h["a"][i + k] for k in range(WINDOW)]).alias("a"),
                    F.xxhash64(*[h["b"][i + k] for k in range(WINDOW)]).alias("b"),
                ),
            ),
        )

    found = let(split_lines(F.col("text")), lambda x: F.when(F.size(x) >= WINDOW, hashed(x)))
    return docs.select("doc_id", text_key().alias("text_key"), F.posexplode(found).alias("at", "w")).select(
        "doc_id", "text_key", "at", "w.a", "w.b"
    )


def later_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, starts): where a document repeats an earlier window, in order."""
    occurrences = windows(docs)
    first = F.min(F.struct("doc_id", "text_key", "at"))
    repeated = stage(
        occurrences.groupBy("a", "b")
        .agg(F.count("*").alias("n"), first.alias("first"))
        .where("n > 1")
        .select("a", "b", "first"),
        "repeated-lines",
    )
    later = occurrences.join(broadcast_below(repeated, 64), ["a", "b"]).where(
        ~(
            F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
            & (F.col("text_key") == F.col("first.text_key"))
            & (F.col("at") == F.col("first.at"))
        )
    )
    return later.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set("at")).alias("starts")
    )


def _gaps(starts: Column, lines: Column) -> Column:
    """What is left between the windows, in order: one piece before each and one at the end."""

    def piece(i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(starts[i - 1] + WINDOW)
        end = F.when(i == F.size(starts), F.size(lines)).otherwise(F.get(starts, i))
        return F.slice(lines, begin + 1, F.greatest(end - begin, F.lit(0)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(starts)), piece))


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, the kept text, and n_lines, n_removed and n_spans of each document."""
    later = stage(later_windows(docs), "later-lines")
    later = broadcast_below(later, 64 + 4 * F.size("starts")).alias("l")
    joined = (
        docs.select("doc_id", "text", text_key().alias("text_key"))
        .alias("d")
        .join(
            later,
            F.col("d.doc_id").eqNullSafe(F.col("l.doc_id"))
            & (F.col("d.text_key") == F.col("l.text_key")),
            "left",
        )
        .select("d.doc_id", "d.text", F.col("l.starts").alias("starts"))
    )
    starts = F.col("starts")
    spans = F.size(
        F.filter(starts, lambda s, i: (i == 0) | (s > F.get(starts, i - 1) + WINDOW))
    )
    lines = split_lines(F.col("text"))
    result = let(
        lines,
        lambda x: let(
            F.when(starts.isNull(), x).otherwise(_gaps(starts, x)),
            lambda kept: F.struct(
                F.array_join(kept, "\n").alias("text"),
                F.size(x).cast("long").alias("n_lines"),
                (F.size(x) - F.size(kept)).cast("long").alias("n_removed"),
            ),
        ),
    )
    return joined.select(
        "doc_id",
        result.alias("r"),
        F.when(starts.isNull(), 0).otherwise(spans).cast("long").alias("n_spans"),
    ).select("doc_id", "r.text", "r.n_lines", "r.n_removed", "n_spans")
