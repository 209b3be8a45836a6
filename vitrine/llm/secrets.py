"""Secret scans, with the number of owners of each candidate as evidence.

Patterns propose candidates.  A candidate's value is hashed, and for each hash the distinct
owners and repositories over the whole corpus are counted.  A value that many owners carry
is an example copied from a manual; one that a single owner carries, with the look of random
characters, may be live.  Assignments, access keys and long hex strings are base kinds and
are always reported; bearer tokens only if they look live.

Null text is empty.  A null owner or repository counts as one of its own.  Rows alike in
doc_id and text get the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import text_key
from vitrine.llm.spans import found, joined, of_kind, plain
from vitrine.sources.staging import stage

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "bearer")
# From so many owners on, a value is an example.
EXAMPLE_OWNERS = 3
# Distinct characters that a live value has at least.
LIVE_CHARACTERS = 8


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"({NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BEARER = r"[Bb]earer\x20+([A-Za-z0-9._~+/=-]+)"
PATTERNS = {
    "assign": ASSIGN,
    # Shorter runs would be dropped anyway, and no later start in a run is longer.
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "bearer": BEARER,
}
CHECKS = {
    "assign": lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) >= 12,
    "access": None,
    "hex": None,
    "bearer": lambda v: F.length(F.regexp_extract(v, BEARER, 1)) >= 20,
}


def _value(s: Column) -> Column:
    return (
        F.when(s["kind"] == "assign", F.regexp_extract(s["value"], ASSIGN, 2))
        .when(s["kind"] == "bearer", F.regexp_extract(s["value"], BEARER, 1))
        .otherwise(s["value"])
    )


def candidates(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """One row per document with its candidate spans; the text is read once."""
    text = F.col("text")
    return docs.select(
        "doc_id",
        text_key().alias("text_key"),
        F.coalesce(owner, F.lit("")).alias("owner"),
        F.coalesce(repository, F.lit("")).alias("repository"),
        plain(text).alias("text"),
    ).select(
        "doc_id",
        "text_key",
        "owner",
        "repository",
        F.concat(*[found(text, kind, PATTERNS[kind], CHECKS[kind]) for kind in KINDS]).alias(
            "spans"
        ),
    )


def ownership(exploded: DataFrame) -> DataFrame:
    """Distinct owners and repositories of each candidate hash.

    Counted in two steps, so a value that a third of all documents carry has come down to a
    row per owner and repository before its rows meet.
    """
    per_owner = exploded.groupBy("hash", "owner", "repository").count()
    return per_owner.groupBy("hash").agg(
        F.count_distinct("owner").alias("n_owners"),
        F.count_distinct("owner", "repository").alias("n_repositories"),
        F.sum("count").alias("n_rows"),
    )


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """doc_id and spans (start, rank, kind, end, n_owners, n_repositories, verdict) in order."""
    rows = stage(candidates(docs, owner, repository), "secret-candidates")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    exploded = (
        rows.withColumn("span", F.explode("spans"))
        .select("doc_id", "text_key", "owner", "repository", "span.*", _value(F.col("span")).alias("secret"))
        .withColumn("hash", F.sha2("secret", 256))
    )
    characters = F.size(F.array_distinct(F.regexp_extract_all("secret", F.lit("."), F.lit(0))))
    looks_live = F.col("secret").rlike("[0-9]") & (characters >= LIVE_CHARACTERS)
    verdict = (
        F.when(F.col("n_owners") >= EXAMPLE_OWNERS, "example")
        .when(looks_live, "live")
        .otherwise("weak")
    )
    judged = (
        exploded.join(ownership(exploded), "hash")
        .withColumn("verdict", verdict)
        .where(F.col("kind").isin(*BASE) | (F.col("verdict") == "live"))
        .groupBy("doc_id", "text_key")
        .agg(
            F.array_sort(
                F.collect_set(
                    F.struct(
                        "start", rank.alias("rank"), "kind", "end",
                        "n_owners", "n_repositories", "verdict",
                    )
                )
            ).alias("spans")
        )
    )
    return (
        rows.select("doc_id", "text_key")
        .alias("d")
        .join(
            judged.alias("j"),
            F.col("d.doc_id").eqNullSafe(F.col("j.doc_id"))
            & (F.col("d.text_key") == F.col("j.text_key")),
            "left",
        )
        .select("d.doc_id", "j.spans")
    )


def report(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, all spans as text, and verdicts."""
    kind = "array<struct<start:int,rank:bigint,kind:string,end:int,n_owners:bigint,n_repositories:bigint,verdict:string>>"
    spans = F.coalesce(F.col("spans"), F.array().cast(kind))

    def judged(verdict: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["verdict"] == verdict)).cast("long")

    return scan(docs, owner, repository).select(
        "doc_id",
        *[F.size(of_kind(spans, kind)).cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(joined(of_kind(spans, *BASE)), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
        judged("live").alias("n_live"),
        judged("example").alias("n_example"),
    )
