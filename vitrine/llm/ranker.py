"""Quality classifier: Bradley-Terry scores learned from preference pairs.

A document labelled good is preferred to one labelled bad.  For pairs (good, bad) the score
w . x is fitted by logistic loss on the difference of their features, which needs no
intercept: only the order counts.  The threshold is a quantile of the fitted scores, the one
that agrees best with the labels, and is placed at 0.3 of the reported score, which is the
logistic function of the distance.

Features are byte and word statistics of the whole text; labels, language, source and ids
are not among them.  It learns from at most ``SAMPLE`` labelled rows, the first by a hash of
the id, and ``PAIRS`` pairs; every document is scored.

Null text is empty and is scored like any text.  Rows are scored one by one, so repeated
rows score alike.  Labels that are null, or that contradict each other, are not learned
from.  Without both kinds of label every score is 0.5.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FOLDS = 5
SAMPLE = 20_000
PAIRS = 60_000
RIDGE = 1e-3
CUT = 0.3
SYMBOLS = [ord(c) for c in "#*$%&<>@^~=+_\\{}[]"]


def features(text: str) -> list[float]:
    data = text.encode()
    size = max(1, len(data))
    words = data.split()
    n = max(1, len(words))
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, digit = seen[65:91].sum(), seen[97:123].sum(), seen[48:58].sum()
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    shares = [
        upper / max(1, upper + lower),
        digit / size,
        seen[SYMBOLS].sum() / size,
        seen[ord("!")] / size,
        seen[ord("|")] / size,
        (seen[ord(".")] + seen[ord(",")]) / size,
        (seen[ord("?")] + seen[ord(":")] + seen[ord(";")]) / size,
        1 - len(set(lines)) / k,
        sum(w.isupper() for w in counts) / max(1, len(counts)),
        sum(not w[-1:].isalnum() and w[-1:] not in b".,;:?!)\"'" for w in words if w[-1] < 128) / n,
        max(counts.values(), default=0) / n,
        seen[128:].sum() / size,
    ]
    return [
        *shares,
        *(math.sqrt(x) for x in shares),
        len(counts) / n / (1 + math.log(n)),
        len(counts) / n,
        math.log1p(len(words)),
        min(50.0, sum(map(len, words)) / n),
        math.log1p(n / k),
        math.log1p(len(lines)),
    ]


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = 10) -> dict:
    """Weights, scaling and threshold from features and labels."""
    centre, spread = x.mean(0), x.std(0)
    spread[spread < 1e-9] = 1.0
    z = np.clip((x - centre) / spread, -8, 8)
    rng = np.random.default_rng(seed)
    above, below = np.flatnonzero(good), np.flatnonzero(~good)
    difference = z[rng.choice(above, pairs)] - z[rng.choice(below, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton steps; the loss is convex
        p = 1 / (1 + np.exp(np.clip(difference @ w, -30, 30)))  # chance that the order is wrong
        slope = difference.T @ p / pairs - RIDGE * w
        bend = (difference * (p * (1 - p))[:, None]).T @ difference / pairs
        step = np.linalg.solve(bend + RIDGE * np.eye(len(w)), slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    scores = z @ w
    # Of the quantiles of the scores, the one that splits the labels best.
    quantiles = np.unique(np.quantile(scores, np.linspace(0.0, 1.0, 1001)))
    order = np.argsort(scores, kind="stable")
    bad_below = np.concatenate([[0], np.cumsum(~good[order])])
    good_below = np.concatenate([[0], np.cumsum(good[order])])
    at = np.searchsorted(scores[order], quantiles, side="left")
    agree = bad_below[at] + (good.sum() - good_below[at])
    best = int(np.argmax(agree))
    return {"w": w, "centre": centre, "spread": spread, "threshold": float(quantiles[best])}


def score(x: np.ndarray, model: dict | None) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    z = np.clip((x - model["centre"]) / model["spread"], -8, 8)
    distance = z @ model["w"] - model["threshold"] + math.log(CUT / (1 - CUT))
    return 1 / (1 + np.exp(-np.clip(distance, -30, 30)))


def fold(doc_id) -> F.col:
    """Remainder of the id's checksum; 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Text and label of at most ``most`` labelled rows outside the held-out fold."""
    agreed = (
        labels.where("quality in (0, 1) and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("good"), F.max("quality").alias("other"))
        .where("good = other")
    )
    chosen = (
        agreed.where(fold(F.col("doc_id")) != 0)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
        .select(F.col("doc_id").alias("id"), "good")
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), "good"
    )


def _featured(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("good"), pa.array(rows, schema.field("x").type)],
            schema=schema,
        )


def _scored(batches: Iterator[pa.RecordBatch], schema: pa.Schema, model: dict | None):
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.array([features(t.as_py()) for t in batch.column("text")])
        found = score(x, model)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("held_out"),
                pa.array(found),
                pa.array((found >= CUT).astype(np.int32)),
            ],
            schema=schema,
        )


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> dict | None:
    chosen = sample(docs, labels, most)
    kind = docs.schema["doc_id"].dataType.simpleString()
    struct = StructType.fromDDL(f"doc_id {kind}, good int, x array<double>")
    schema = to_arrow_schema(struct)
    rows = chosen.withColumn("good", F.col("good").cast("int")).mapInArrow(
        lambda b: _featured(b, schema), struct
    ).toPandas()  # at most ``most`` rows, a few hundred bytes each
    rows = rows.sort_values("doc_id", kind="stable")
    good = rows["good"].to_numpy() == 1
    if not len(rows) or good.all() or not good.any():
        return None
    return fit(np.array(rows["x"].tolist()), good)


def classify(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    struct = StructType.fromDDL(f"doc_id {kind}, held_out boolean, score double, predicted int")
    schema = to_arrow_schema(struct)
    return docs.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).mapInArrow(lambda b: _scored(b, schema, model), struct)
