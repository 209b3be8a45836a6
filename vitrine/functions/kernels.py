"""Array code that runs inside Python tasks.

The module is pickled by value, so executors need numpy and pyarrow but not this package.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PICK_FIELDS = [
    ("position", pa.int32()),
    ("pick_score", pa.float64()),
    ("penalty", pa.float64()),
]
# Requests worked on together, which bounds the size of the matrices.
CHUNK = 256


def greedy_chunk(
    scores: np.ndarray, traits: list[np.ndarray], table: np.ndarray, k: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy picks for the rows of a score matrix, padded with -inf.

    ``table`` holds each row's penalties by cluster match, category match and tiers apart.
    Returns position and score at the time for every step, and the final penalties.
    """
    rows = np.arange(len(scores))
    cluster, category, tier = traits
    n_tiers = table.shape[1] // 4
    penalties = np.zeros_like(scores)
    open_scores = scores.copy()
    steps = int(k.max(initial=0))
    positions = np.zeros((len(scores), steps), dtype=np.int64)
    at_pick = np.zeros((len(scores), steps))
    for step in range(steps):
        adjusted = open_scores - penalties
        # The first of equal maxima: rows are sorted, so the better raw score, the lower id.
        best = adjusted.argmax(axis=1)
        positions[:, step] = best
        at_pick[:, step] = adjusted[rows, best]
        slot = np.abs(tier - tier[rows, best][:, None])
        slot += 2 * n_tiers * (cluster == cluster[rows, best][:, None])
        slot += n_tiers * (category == category[rows, best][:, None])
        raised = np.take_along_axis(table, slot, axis=1)
        raised[rows, best] = 0.0
        raised[step >= k] = 0.0
        np.maximum(penalties, raised, out=penalties)
        open_scores[rows, best] = -np.inf
    return positions, at_pick, penalties


def greedy_picks(
    scores: pa.Array,
    clusters: pa.Array,
    categories: pa.Array,
    tiers: pa.Array,
    tables: pa.Array,
    ks: pa.Array,
) -> pa.Array:
    """Positions picked from each row's candidates, which come best score first.

    Works on many rows at a time: one matrix step per pick instead of one expression per
    candidate and pick.
    """

    def numbers(column: pa.Array) -> np.ndarray:
        return column.to_numpy(zero_copy_only=False)

    def codes(column: pa.Array) -> np.ndarray:
        return numbers(column.flatten().dictionary_encode().indices).astype(np.int64)

    sizes = numbers(pc.list_value_length(scores)).astype(np.int64)
    ends = np.cumsum(sizes)
    values = numbers(scores.flatten())
    traits = [codes(clusters), codes(categories), numbers(tiers.flatten()).astype(np.int64)]
    table = numbers(tables.flatten()).reshape(len(sizes), -1)
    k = np.minimum(numbers(ks).astype(np.int64), sizes)
    found: list[list[np.ndarray]] = [[], [], []]
    for first in range(0, len(sizes), CHUNK):
        rows = slice(first, first + CHUNK)
        here = sizes[rows]
        filled = np.arange(here.max(initial=0)) < here[:, None]
        inside = slice(ends[first] - sizes[first], ends[rows][-1])

        def padded(source: np.ndarray, blank) -> np.ndarray:
            matrix = np.full(filled.shape, blank, dtype=source.dtype)
            matrix[filled] = source[inside]
            return matrix

        positions, at_pick, penalties = greedy_chunk(
            padded(values, -np.inf), [padded(code, 0) for code in traits], table[rows], k[rows]
        )
        used = np.arange(positions.shape[1]) < k[rows][:, None]
        found[0].append(positions[used])
        found[1].append(at_pick[used])
        found[2].append(np.take_along_axis(penalties, positions, axis=1)[used])
    arrays = [np.concatenate(part) if part else np.array([]) for part in found]
    picks = pa.StructArray.from_arrays(
        [pa.array(a, type=kind) for a, (_, kind) in zip(arrays, PICK_FIELDS)],
        names=[name for name, _ in PICK_FIELDS],
    )
    offsets = np.concatenate([[0], np.cumsum(k)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), picks)
