"""Personal data: patterns propose, checksums confirm, nearby words adjust the score.

Each kind has a prior.  A checksum (Luhn for cards, mod 97 for account numbers) raises it,
and so does a word of the kind's context within forty code points before the match.  Spans
from the threshold up are reported.  E-mail, IP, card and phone are base kinds: what their
pattern and check accept is always reported, whatever the score.

Null text is empty and has no spans.  Rows are judged one by one.  Patterns never nest loops
that backtrack: long runs of digits or letters take linear time and no stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import let
from vitrine.llm.spans import found, joined, of_kind, plain

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
THRESHOLD = 0.6
NEAR = 40

# A match can only begin where a run begins, or where the last match ended.  Possessive
# quantifiers keep no state to go back to.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]++",
    "ssn": r"(?:\G|(?<![0-9]))[0-9]++-[0-9]++-[0-9]++",
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.7, "iban": 0.5, "ssn": 0.3}
CHECKED = {"card": 0.4, "iban": 0.4}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "host|server|address",
    "card": "card|visa|payment",
    "phone": "phone|call|mobile",
    "iban": "iban|account|bank",
    "ssn": "ssn|social security|taxpayer",
}
BOOST = {"email": 0.1, "ip": 0.2, "card": 0.1, "phone": 0.2, "iban": 0.1, "ssn": 0.4}


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = digits.substr(F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod_97(value: Column) -> Column:
    """Letters count as 10 to 35; the first four characters go to the end."""
    turned = F.concat(value.substr(F.lit(5), F.length(value)), value.substr(F.lit(1), F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        number = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.when(number > 9, rest * 100 + number).otherwise(rest * 10 + number) % 97

    return F.aggregate(F.regexp_extract_all(turned, F.lit("."), F.lit(0)), F.lit(0), step) == 1


def _between(value: Column, least: int, most: int) -> Column:
    return (value >= least) & (value <= most)


def valid_ip(value: Column) -> Column:
    return F.forall(
        F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) < 4
    ) & F.forall(
        F.split(value, r"\."),
        lambda p: F.coalesce(F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int"), F.lit(0)) <= 255,
    )


def valid_card(value: Column) -> Column:
    return let(
        digits_of(value), lambda d: F.when(_between(F.length(d), 13, 19), luhn(d)).otherwise(False)
    )


CHECKS = {
    "email": None,
    "ip": valid_ip,
    "card": valid_card,
    "phone": lambda v: _between(F.length(digits_of(v)), 9, 15),
    "iban": lambda v: F.when(_between(F.length(v), 15, 34), mod_97(v)).otherwise(False),
    "ssn": lambda v: v.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
}


def scored(text: Column, kind: str) -> Column:
    """Spans of a kind that pass its check, with their score."""

    def score(s: Column) -> Column:
        begin = F.greatest(s["start"] - NEAR, F.lit(0))
        before = F.lower(text.substr(begin + 1, s["start"] - begin))
        near = F.when(before.rlike(CONTEXT[kind]), F.lit(BOOST[kind])).otherwise(F.lit(0.0))
        return F.struct(
            s["kind"], s["start"], s["end"],
            F.round(F.lit(PRIOR[kind] + CHECKED.get(kind, 0.0)) + near, 2).alias("score"),
        )

    spans = F.transform(found(text, kind, PATTERNS[kind], CHECKS[kind]), score)
    if kind in BASE:
        return spans
    return F.filter(spans, lambda s: s["score"] >= THRESHOLD)


def find(docs: DataFrame) -> DataFrame:
    """doc_id and the spans (kind, start, end, score) by kind as listed, then start."""
    return docs.select("doc_id", plain(F.col("text")).alias("text")).select(
        "doc_id",
        F.concat(*[scored(F.col("text"), kind) for kind in KINDS]).alias("spans"),
    )


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    counts = [F.size(of_kind(spans, kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    return find(docs).select(
        "doc_id",
        *counts,
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )
