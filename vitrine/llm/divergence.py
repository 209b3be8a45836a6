"""How far the sources of a language are apart, over run-length encoded count columns.

Terms are counted once per (lang, source, term).  A language's vocabulary, the terms that
enough of its documents hold, is a table with a column of counts for each source.  Terms with
the same counts everywhere become one entry with a multiplicity; entries are sorted so that
equal counts stand next to each other, and each column is run-length encoded, absent terms
being runs of zero.  For a pair of sources the runs' boundaries are intersected; between two
of them both counts are constant, so the divergence there is f of one term times the length.

A pair's sum is a sum over slices of the vocabulary: each task encodes the slice that it holds
and returns partial sums, so neither a vocabulary nor a column has to fit one task.

With count and N over the kept terms and V of these, p = 1 + floor(1e9 (count + 1) / (N + V)),
and f = floor((p - q)^2 / q).  All of it in integers.

A row for each (lang, source) group goes to every task; the pairs of the result are the
square of that.  Null text, lang and source are ''.  A row is a document, also where rows or
ids repeat.  Ties in value go to the item of lower UTF-8 order.  An empty table gives no
rows; a language without kept terms has its pairs at 0.  Other columns are not read.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import broadcast_below, map_batches, portions, record_batch
from vitrine.sources.staging import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Letters of ASCII and all other characters.
TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
UNIT = 1_000_000_000
LEAST_DOCUMENTS = 3
TOP_TERMS = 200
# Distinct terms that a task counts before it sends them on, and matches taken at a time.
HELD = 400_000
AT_ONCE = 100_000
# Counts of a slice of the vocabulary that is encoded at a time.
SLICE = 500_000


def _counted(batches: Iterator[pa.RecordBatch], schema: pa.Schema):
    """(lang, source, term, count, n_docs), summed over as much of the task as is held."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush():
        for (lang, source), (number, holders) in groups.items():
            terms = list(number)
            for low in range(0, len(terms), AT_ONCE):
                some = terms[low : low + AT_ONCE]
                columns = [
                    pa.repeat(lang, len(some)), pa.repeat(source, len(some)), pa.array(some),
                    pa.array([number[t] for t in some], pa.int64()),
                    pa.array([holders[t] for t in some], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        groups.clear()

    for batch in portions(batches):
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            number, holders = groups.setdefault((lang, source), (Counter(), Counter()))
            # Only A to Z: bytes outside ASCII stay as they are.
            text = text.encode().lower().decode()
            if len(text) <= AT_ONCE:
                terms = TERM.findall(text)
                number.update(terms)
                holders.update(set(terms))
                continue
            matches, seen = TERM.finditer(text), set()
            while some := [m[0] for m in islice(matches, AT_ONCE)]:
                number.update(some)
                seen.update(some)
            holders.update(seen)
        if sum(len(number) for number, _ in groups.values()) > HELD:
            yield from flush()
    yield from flush()


def probability(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(UNIT (count + 1) / total)."""
    if len(count) and int(count.max()) >= (1 << 63) // UNIT - 1:
        return np.array([1 + UNIT * (int(c) + 1) // total for c in count], np.int64)
    return 1 + UNIT * (count + 1) // total


def encoded(entries: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, counts) of the runs of a column that has counts at some entries and else 0."""
    at = np.concatenate([[0], entries + 1, entries])
    value = np.concatenate([np.zeros(len(entries) + 1, np.int64), counts])
    order = np.argsort(at, kind="stable")
    at, value = at[order], value[order]
    final = np.append(at[1:] != at[:-1], True)  # a count at an entry replaces the end before it
    at, value = at[final], value[final]
    new = np.append(True, value[1:] != value[:-1])
    return at[new], value[new]


def divergence(left: tuple, right: tuple, before: np.ndarray) -> tuple[int, int]:
    """Sums of f both ways for two columns of (starts, p); ``before`` counts terms before an entry."""
    bounds = np.union1d(left[0], right[0])
    bounds = bounds[bounds < len(before) - 1]
    p = left[1][np.searchsorted(left[0], bounds, "right") - 1]
    q = right[1][np.searchsorted(right[0], bounds, "right") - 1]
    lengths = np.diff(np.append(before[bounds], before[-1]))
    square = (p - q) ** 2
    return int((square // q * lengths).sum()), int((square // p * lengths).sum())


def _pairs(batches: Iterator[pa.RecordBatch], schema: pa.Schema, groups: dict[str, dict[str, int]]):
    """Partial sums (lang, source, item, value) of the slices of the vocabulary in this task."""
    lang, times, entries, sources, counts = None, [], [], [], []

    def close():
        before = np.concatenate([[0], np.cumsum(np.array(times, np.int64))])
        at, who, count = (np.array(x, np.int64) for x in (entries, sources, counts))
        order = np.lexsort((at, who))
        at, who, count = at[order], who[order], count[order]
        columns = []
        for i, total in enumerate(groups[lang].values()):
            low, high = np.searchsorted(who, [i, i + 1])
            starts, run = encoded(at[low:high], count[low:high])
            columns.append((starts, probability(run, total)))
        rows = []
        for (a, left), (b, right) in combinations(zip(groups[lang], columns), 2):
            there, back = divergence(left, right, before)
            rows += [(lang, a, b, there), (lang, b, a, back)]
            if len(rows) >= AT_ONCE:
                yield record_batch(list(zip(*rows)), schema)
                rows = []
        if rows:
            yield record_batch(list(zip(*rows)), schema)
        for held in (times, entries, sources, counts):
            held.clear()

    for batch in portions(batches):
        for row in batch.to_pylist():
            if times and (row["lang"] != lang or len(counts) >= SLICE):
                yield from close()
            if row["lang"] != lang:
                lang = row["lang"]
                index = {source: i for i, source in enumerate(groups[lang])}
            for x in row["spread"]:
                entries.append(len(times))
                sources.append(index[x["source"]])
                counts.append(x["count"])
            times.append(row["times"])
    if times:
        yield from close()


def _p(count: str, total: str) -> Column:
    return F.expr(
        f"1 + cast({UNIT} as decimal(10,0)) * cast({count} + 1 as decimal(20,0)) div cast({total} as decimal(20,0))"
    )


def vocabulary(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, spread): the kept terms of each language with their counts by source."""
    columns = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]
    counted = map_batches(
        docs.select(*columns), _counted, "lang string, source string, term string, count long, n_docs long"
    )
    by_source = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("count").alias("count"), F.sum("n_docs").alias("n_docs")
    )
    spread = F.sort_array(F.collect_list(F.struct("source", "count")))
    return by_source.groupBy("lang", "term").agg(
        spread.alias("spread"), F.sum("n_docs").alias("n_docs")
    ).where(F.col("n_docs") >= least).drop("n_docs")


def group_sizes(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, total): N + V of every group that occurs."""
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    held = terms.select("lang", F.inline("spread")).groupBy("lang", "source").agg(F.sum("count").alias("n"))
    kept = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    return groups.join(F.broadcast(held), ["lang", "source"], "left").join(F.broadcast(kept), "lang", "left").select(
        "lang", "source", (F.coalesce("n", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("total")
    )


def pair_divergence(terms: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language."""
    groups: dict[str, dict[str, int]] = {}
    for row in sizes.orderBy("lang", "source").toLocalIterator():
        groups.setdefault(row["lang"], {})[row["source"]] = row["total"]
    # Terms that agree in all counts are one entry; sorting brings equal counts together.
    entries = stage(terms.groupBy("lang", "spread").agg(F.count(F.lit(1)).alias("times")), "entries")
    order = ["lang", "n_sources", "spread"]
    entries = entries.withColumn("n_sources", F.size("spread"))
    sliced = entries.repartitionByRange(*order).sortWithinPartitions(*order)
    found = map_batches(sliced, _pairs, "lang string, source string, item string, value long", groups)
    others = sizes.select("lang", F.col("source").alias("item"))
    zero = sizes.select("lang", "source").join(others, "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    return found.unionByName(zero).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def telling_terms(terms: DataFrame, sizes: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a source has more of than its language."""
    count = F.expr("aggregate(spread, 0L, (all, x) -> all + x.count)")
    own = terms.select("lang", "term", count.alias("n"), "spread")
    n = own.groupBy("lang").agg((F.sum("n") + F.count(F.lit(1))).alias("whole"))
    own = own.join(F.broadcast(n), "lang").select("lang", F.col("term").alias("item"), _p("n", "whole").alias("q"), F.inline("spread"))
    scored = own.join(broadcast_below(sizes, 64), ["lang", "source"]).withColumn("p", _p("count", "total")).where("p > q")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return scored.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value")).withColumn(
        "rank", F.row_number().over(best)
    ).where(F.col("rank") <= top)


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    terms = stage(vocabulary(docs), "vocabulary")
    sizes = stage(group_sizes(docs, terms), "group-sizes")
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_divergence(terms, sizes).withColumn("rank", F.row_number().over(ranks))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(
        telling_terms(terms, sizes).withColumn("part", F.lit("term")).select(*columns)
    )
