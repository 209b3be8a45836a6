"""Positions of regular-expression matches, in DataFrame functions.

Spark's functions return what matched but not where.  Here each match is put between two
control characters, the text is split at them, and the lengths of the pieces give the
places, counted in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.llm.common import let

OPEN, CLOSE = "\x01", "\x02"
NONE = "array<struct<kind:string,start:int,end:int,value:string>>"


def plain(text: Column) -> Column:
    """The text without null and without the two marks; each becomes another control character."""
    return F.translate(F.coalesce(text, F.lit("")), OPEN + CLOSE, "\x03\x03")


def none() -> Column:
    return F.array().cast(NONE)


def found(text: Column, kind: str, pattern: str, valid=None) -> Column:
    """Leftmost non-overlapping matches as (kind, start, end, value); failing ones dropped."""
    parts = F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]")

    def spans(p: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            value = p[2 * i - 1]
            end = s["at"] + F.char_length(value)
            one = F.struct(
                F.lit(kind).alias("kind"), s["at"].alias("start"), end.alias("end"), value.alias("value")
            )
            kept = F.array(one)
            if valid is not None:
                kept = F.when(valid(value), kept).otherwise(none())
            return F.struct(
                (end + F.char_length(p[2 * i])).alias("at"),
                F.concat(s["spans"], kept).alias("spans"),
            )

        start = F.struct(F.char_length(p[0]).alias("at"), none().alias("spans"))
        return F.aggregate(
            F.sequence(F.lit(1), F.floor((F.size(p) - 1) / 2).cast("int")),
            start,
            step,
            lambda s: s["spans"],
        )

    return F.when(text.rlike(pattern), let(parts, spans)).otherwise(none())


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
