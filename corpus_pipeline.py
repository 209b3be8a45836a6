"""A training corpus from raw documents: filter, deduplicate, decontaminate, mix, encode.

Each stage takes the documents that the one before it kept and returns documents again; the
last writes the encoded corpus and returns what reading it back gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitrine.llm import decontaminate, jaccard, mixing, quality, rans
from vitrine.llm.common import documents
from vitrine.sources.staging import stage


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands."""
    return quality.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return jaccard.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their weights: a row for each pass over a document."""
    return mixing.mixed(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as token ids, written, and read back."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return rans.read_corpus(spark, rans.write_corpus(docs, path))


STAGES = [
    ("quality", filter_quality),
    ("near_copies", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("mix", mix_sources),
    ("encode", encode_tokens),
]

# Compression ratios and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
