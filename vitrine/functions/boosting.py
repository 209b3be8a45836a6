"""Boosted trees over binned rows as array code that runs inside Python tasks.

The tasks of one barrier stage keep their rows, a byte for each value, for all the trees.  For each
level of a tree they hand each other sums by node and bin as small files in the shared folder, and
each works out the same splits.  (``allGather`` would do, but takes a second each time.)  Bins, samples,
splits and leaves are those of ``pyspark.ml``, which runs a job for each level; sums of several tasks
are added in the order of the tasks, where Spark adds them as they come.

The module is pickled by value, so executors need numpy and pyarrow but not this package.
"""

from __future__ import annotations

import json
import math
import os
import pickle
import sys
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows that are worked on at a time, so that their numbers stay in the caches.
BLOCK = 1 << 17
# A block of this many rows is added up by the bins of two features at once, and those are added up then.
PAIRED = 1 << 15
# Rows whose values are looked at to place the edges of the bins.
LOOKED_AT = 10_000
# Streams that numbers are drawn from side by side.
LANES = 1 << 12
EPSILON = 2.0**-52
WORD, HALF = 2**64 - 1, 2**32 - 1
INVALID = -sys.float_info.max


@dataclass(frozen=True)
class Settings:
    """The parameters of a booster.  ``logistic`` takes labels 0 and 1, else errors are squared."""

    trees: int
    depth: int
    step: float
    share: float
    seed: int
    bins: int
    logistic: bool


# Random numbers as Spark draws them


def mixed(data: bytes, state: int) -> int:
    """MurmurHash3 of whole words."""
    for start in range(0, len(data), 4):
        word = int.from_bytes(data[start : start + 4], "little") * 0xCC9E2D51 & HALF
        word = (word << 15 | word >> 17) & HALF
        state ^= word * 0x1B873593 & HALF
        state = (state << 13 | state >> 19) & HALF
        state = (state * 5 + 0xE6546B64) & HALF
    state ^= len(data)
    state = (state ^ state >> 16) * 0x85EBCA6B & HALF
    state = (state ^ state >> 13) * 0xC2B2AE35 & HALF
    return state ^ state >> 16


def first_state(seed: int) -> int:
    data = (seed & WORD).to_bytes(8, "big")
    low = mixed(data, 0x3C074A61)
    return mixed(data, low) << 32 | low


def after(state: int) -> int:
    state ^= state << 21 & WORD
    state ^= state >> 35
    return state ^ (state << 4 & WORD)


def drawn(seed: int) -> Iterator[float]:
    """Numbers from 0 to 1, one by one."""
    state = first_state(seed)
    while True:
        state = after(state)
        high = state & (1 << 26) - 1
        state = after(state)
        yield ((high << 27) + (state & (1 << 27) - 1)) * 2.0**-53


def first_int(seed: int) -> int:
    value = after(first_state(seed)) & HALF
    return value - (1 << 32) if value >> 31 else value


def part_seed(seed: int, part: int) -> int:
    """The seed of a part of a sample: a long of ``java.util.Random`` for each part."""
    state = (seed ^ 0x5DEECE66D) & (1 << 48) - 1

    def next_int() -> int:
        nonlocal state
        state = (state * 0x5DEECE66D + 0xB) & (1 << 48) - 1
        value = state >> 16
        return value - (1 << 32) if value >> 31 else value

    for _ in range(part + 1):
        high = next_int()
        value = (high << 32) + next_int()
    return value


def moved(states: np.ndarray, images: np.ndarray) -> np.ndarray:
    """States after the steps whose images of the 64 single bits are given; steps are linear."""
    found = np.zeros_like(states)
    for bit, image in enumerate(images):
        found ^= np.where(states >> np.uint64(bit) & np.uint64(1), image, np.uint64(0))
    return found


class Draws:
    """The first ``n`` numbers that ``drawn`` gives for a seed, as an array."""

    def __init__(self, n: int):
        self.n = n
        self.lanes = max(1, min(LANES, 1 << (n // 64).bit_length()))
        self.each = -(-n // self.lanes)
        bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
        once = np.array([after(int(bit)) for bit in bits], dtype=np.uint64)
        jump = bits
        for digit in bin(2 * self.each)[2:]:
            jump = moved(jump, jump)
            if digit == "1":
                jump = moved(jump, once)
        self.jumps = []
        for _ in range(self.lanes.bit_length() - 1):
            self.jumps.append(jump)
            jump = moved(jump, jump)

    def __call__(self, seed: int) -> np.ndarray:
        states = np.array([first_state(seed)], dtype=np.uint64)
        for jump in self.jumps:
            states = np.concatenate([states, moved(states, jump)])
        numbers = np.empty((self.each, self.lanes))
        for row in numbers:
            self.go_on(states)
            high = (states & np.uint64((1 << 26) - 1)) << np.uint64(27)
            self.go_on(states)
            row[:] = high + (states & np.uint64((1 << 27) - 1))
        return numbers.T.reshape(-1)[: self.n] * 2.0**-53

    @staticmethod
    def go_on(states: np.ndarray) -> None:
        states ^= states << np.uint64(21)
        states ^= states >> np.uint64(35)
        states ^= states << np.uint64(4)


def looked_at(n: int, share: float, seed: int) -> np.ndarray:
    """The places of a sample of ``n`` rows: between two of them is a drawn gap, or each row is
    drawn for where many are taken."""
    if share >= 1:
        return np.arange(n)
    if share > 0.4:
        return np.flatnonzero(Draws(n)(seed) <= share)
    places, place = [], -1
    for number in drawn(seed):
        place += 1 + int(math.log(max(number, 5e-11)) / math.log1p(-share))
        if place >= n:
            return np.array(places, dtype=np.int64)
        places.append(place)
    return np.array(places, dtype=np.int64)


# Bins


def edges_of(
    values: np.ndarray, weights: np.ndarray, share: float, total: float, bins: int
) -> np.ndarray:
    """The edges of the bins of a feature, from a sample that holds ``share`` of the rows, which
    weigh ``total``."""
    kept = values != 0
    distinct, places = np.unique(values[kept], return_inverse=True)
    if not len(distinct):
        return distinct
    sums = np.bincount(places, weights[kept])
    expected = share * total
    zeros = expected - sums.sum()
    if zeros > EPSILON * len(places) * 100:
        at = np.searchsorted(distinct, 0.0)
        distinct, sums = np.insert(distinct, at, 0.0), np.insert(sums, at, zeros)
    middles = (distinct[:-1] + distinct[1:]) / 2
    if len(middles) < bins:
        return middles
    stride = expected / bins
    edges, seen, wanted = [], sums[0], stride
    for place, weight in enumerate(sums[1:].tolist()):
        before, seen = seen, seen + weight
        if abs(before - wanted) < abs(seen - wanted):
            edges.append(middles[place])
            wanted += stride
    return np.array(edges)


# Trees


@dataclass
class Node:
    """``stats`` are weight, sum, sum of squares and number of the node's rows."""

    stats: np.ndarray
    impurity: float
    leaf: bool
    gain: float = -1.0
    feature: int = -1
    bin: int = -1
    children: list[int] = field(default_factory=list)

    @property
    def value(self) -> float:
        return float(self.stats[1] / self.stats[0])


def variance(stats: np.ndarray) -> np.ndarray:
    """Of weight, sum and sum of squares along the first axis."""
    weight = np.where(stats[0] == 0, 1.0, stats[0])
    return np.where(stats[0] == 0, 0.0, (stats[2] - stats[1] * stats[1] / weight) / weight)


class Rows:
    """The rows of a task."""

    def __init__(self, bins: np.ndarray, edges: list[np.ndarray], weight: np.ndarray | None, gather: Callable):
        self.bins, self.weight, self.gather = bins, weight, gather
        self.n_splits = np.array([len(one) for one in edges])
        self.width = int(self.n_splits.max(initial=0)) + 1
        self.at = np.zeros(bins.shape[1], dtype=np.int16)
        self.codes = bins
        if bins.shape[1] >= PAIRED:
            self.codes = self.width * bins[::2].astype(np.uint16)
            self.codes[: len(bins) // 2] += bins[1::2]

    def blocks(self) -> list[slice]:
        n_rows = self.bins.shape[1]
        return [slice(start, min(start + BLOCK, n_rows)) for start in range(0, n_rows, BLOCK)]

    def begin(self, target: np.ndarray, taken: np.ndarray) -> None:
        """Start a tree for ``target`` with the rows that are ``taken``."""
        self.at[:] = 0
        self.bag = []
        for block in self.blocks():
            rows = np.flatnonzero(taken[block])
            y = target[block][rows]
            w = None if self.weight is None else self.weight[block][rows]
            wy = y if w is None else w * y
            self.bag.append((block, rows, self.codes[:, block][:, rows], w, wy, wy * y))

    def sums(self, slot_of: np.ndarray, n_slots: int) -> np.ndarray:
        """(statistic, slot, feature, bin) over the rows of all tasks; nodes without a slot have
        the one after the last, which is left out."""
        n_stats, n_features = 3 if self.weight is None else 4, len(self.bins)
        paired = self.codes is not self.bins
        by_bin = (n_slots + 1, self.width, self.width if paired else 1)
        found = np.zeros((n_stats, n_features, n_slots + 1, self.width))
        first = slot_of * (by_bin[1] * by_bin[2])
        size = int(np.prod(by_bin))
        for block, rows, codes, *kinds in self.bag:
            base = first[self.at[block][rows]]
            places = np.empty_like(base)
            kinds = kinds if self.weight is None else [*kinds, None]
            for number, code in enumerate(codes):
                np.add(base, code, out=places)
                for stat, kind in enumerate(kinds):
                    here = np.bincount(places, kind, size).reshape(by_bin)
                    if not paired:
                        found[stat, number] += here[:, :, 0]
                        continue
                    found[stat, 2 * number] += here.sum(axis=2)
                    if 2 * number + 1 < n_features:
                        found[stat, 2 * number + 1] += here.sum(axis=1)
        found = found[:, :, :-1]
        parts = self.gather(np.ascontiguousarray(found))
        total = parts[0]
        for part in parts[1:]:
            total = total + part
        return total.transpose(0, 2, 1, 3)

    def go_down(self, nodes: list[Node]) -> None:
        """Rows of nodes that were split go to the children."""
        feature = np.array([max(node.feature, 0) for node in nodes]) * self.bins.shape[1]
        last = np.array([node.bin if node.children else 255 for node in nodes], dtype=np.int16)
        left = np.array([node.children[0] if node.children else n for n, node in enumerate(nodes)], dtype=np.int16)
        flat = self.bins.reshape(-1)
        for block in self.blocks():
            at = self.at[block]
            places = feature[at] + np.arange(block.start, block.stop)
            self.at[block] = left[at] + (flat[places] > last[at])


def best_splits(sums: np.ndarray, n_splits: np.ndarray, nodes: list[Node]) -> list[tuple]:
    """(gain, feature, bin, left, right) of each node, the first of equals."""
    summed = np.cumsum(sums, axis=3)
    left = summed[..., :-1]
    right = summed[..., -1:] - left
    if len(sums) == 3:
        numbers = left[0], right[0]
    else:
        numbers = left[3], right[3]
    impurity = np.array([node.impurity for node in nodes])[:, None, None]
    total = left[0] + right[0]
    total = np.where(total == 0, 1.0, total)
    gain = impurity - left[0] / total * variance(left) - right[0] / total * variance(right)
    gain[(numbers[0] < 1) | (numbers[1] < 1) | (gain < 0)] = INVALID
    gain[:, np.arange(gain.shape[2]) >= n_splits[:, None]] = -np.inf
    bins = gain.argmax(axis=2)
    best = np.take_along_axis(gain, bins[:, :, None], axis=2)[:, :, 0]
    features = best.argmax(axis=1)
    found = []
    for place, feature in enumerate(features):
        chosen = place, feature, bins[place, feature]
        found.append((gain[chosen], int(feature), int(chosen[2]), left[:, *chosen], right[:, *chosen]))
    return found


def whole(stats: np.ndarray) -> np.ndarray:
    """With the number of rows, which is their weight where they have none."""
    return stats if len(stats) == 4 else np.append(stats, stats[0])


def grown(rows: Rows, depth: int) -> list[Node]:
    """A tree; the root comes first and siblings side by side."""
    nodes: list[Node] = []
    level = [0]
    for deep in range(depth):
        slot_of = np.full(max(len(nodes), 1), len(level))
        slot_of[level] = np.arange(len(level))
        sums = rows.sums(slot_of, len(level))
        if not deep:
            nodes.append(root_of(sums, rows.n_splits))
        if not rows.n_splits.any():
            nodes[0].leaf, nodes[0].impurity = True, -1.0
            break
        for number, (gain, feature, bin_, left, right) in zip(
            level, best_splits(sums, rows.n_splits, [nodes[n] for n in level])
        ):
            node = nodes[number]
            if gain <= 0:
                node.leaf = True
                node.impurity = node.impurity if gain == 0 else -1.0
                continue
            node.gain, node.feature, node.bin = float(gain), feature, bin_
            node.children = [len(nodes), len(nodes) + 1]
            for part in (whole(left), whole(right)):
                impurity = float(variance(part))
                pure = deep + 1 == depth or abs(impurity) < EPSILON
                nodes.append(Node(part, impurity, pure))
        rows.go_down(nodes)
        level = [child for n in level for child in nodes[n].children if not nodes[child].leaf]
        if not level:
            break
    return nodes


def root_of(sums: np.ndarray, n_splits: np.ndarray) -> Node:
    feature = int(np.argmax(n_splits > 0))
    by_bin = np.cumsum(sums[:, 0, feature], axis=1)
    stats = by_bin[:, -1]
    if n_splits[feature]:
        stats = by_bin[:, 0] + (stats - by_bin[:, 0])
    stats = whole(stats)
    return Node(stats, float(variance(stats)), False)


def saved(nodes: list[Node], edges: list[np.ndarray], tree: int) -> list[tuple]:
    """The nodes as rows, numbered from the root down, left before right."""
    found: list[tuple] = []
    # What a node gives, whatever its row: a leaf does, or one whose leaves give the same.
    ends: list[float | None] = [node.value for node in nodes]
    for number in reversed(range(len(nodes))):
        if nodes[number].children:
            left, right = (ends[child] for child in nodes[number].children)
            ends[number] = left if left is not None and left == right else None

    def add(number: int) -> int:
        node, place = nodes[number], len(found)
        stats, count = node.stats[:3].tolist(), int(node.stats[3])
        found.append(())
        if ends[number] is not None:
            row = ends[number], node.impurity, stats, count, -1.0, -1, -1, -1, None
        else:
            left, right = (add(child) for child in node.children)
            edge = float(edges[node.feature][node.bin])
            row = node.value, node.impurity, stats, count, node.gain, left, right, node.feature, edge
        found[place] = (tree, place, *row)
        return place

    add(0)
    return found


SAVED = (
    "tree int, id int, prediction double, impurity double, stats array<double>, count bigint, "
    "gain double, left int, right int, feature int, edge double"
)


def residuals(margin: np.ndarray, label: np.ndarray, logistic: bool) -> np.ndarray:
    if logistic:
        with np.errstate(over="ignore"):
            return 4.0 * label / (1.0 + np.exp(2.0 * label * margin))
    return 2.0 * (label - margin)


# Tasks


class Exchange:
    """What each task of the stage hands over, in the order of the tasks.

    A file is complete once it has its name.  A task that has read the files of a round has those of
    the round before behind it, and so have all others: each then removes its own.  When a task
    fails, Spark ends and repeats them all, in a folder of its own.
    """

    def __init__(self, context: BarrierTaskContext, folder: str):
        self.part, self.n_parts = context.partitionId(), len(context.getTaskInfos())
        self.round, self.shared = 0, True
        if self.n_parts > 1:
            own = f"{folder}/{uuid.uuid4().hex}"
            os.makedirs(own, exist_ok=True)
            self.folder = context.allGather(own)[0]
            seen = context.allGather(json.dumps(os.path.isdir(self.folder)))
            self.shared = all(json.loads(one) for one in seen)

    def __call__(self, own) -> list:
        if self.n_parts == 1:
            return [own]
        path = self.path(self.round, self.part)
        with open(f"{path}.new", "wb") as file:
            pickle.dump(own, file, protocol=5)
        os.replace(f"{path}.new", path)
        found = [own if part == self.part else self.read(part) for part in range(self.n_parts)]
        if self.round:
            os.remove(self.path(self.round - 1, self.part))
        self.round += 1
        return found

    def path(self, number: int, part: int) -> str:
        return f"{self.folder}/{number}-{part}"

    def read(self, part: int):
        wait = 1e-4
        while True:
            try:
                with open(self.path(self.round, part), "rb") as file:
                    return pickle.load(file)
            except FileNotFoundError:
                time.sleep(wait)
                wait = min(2 * wait, 5e-3)


class Input:
    """The rows of a task as they come; the features wait in a file until they are binned."""

    def __init__(self, batches: Iterator[pa.RecordBatch], n_features: int):
        self.file, self.n_features = tempfile.TemporaryFile(), n_features
        labels, weights = [], []
        for batch in batches:
            labels.append(self.doubles(batch.column("label")))
            weights.append(self.doubles(batch.column("weight")))
            values = self.doubles(batch.column("features").flatten())
            if len(values) != len(labels[-1]) * n_features:
                raise ValueError("a row lacks features")
            self.file.write(values.tobytes())
        none = [np.empty(0)]
        self.label, self.weight = np.concatenate(none + labels), np.concatenate(none + weights)

    @staticmethod
    def doubles(column: pa.Array) -> np.ndarray:
        values = column.fill_null(np.nan).to_numpy(zero_copy_only=False)
        if not np.isfinite(values).all():
            raise ValueError("labels, weights and features must not be null, NaN or infinite")
        return values

    def features(self) -> Iterator[np.ndarray]:
        self.file.seek(0)
        while data := self.file.read(BLOCK * self.n_features * 8):
            yield np.frombuffer(data).reshape(-1, self.n_features)


def binned(given: Input, settings: Settings, part: int, gather: Callable) -> tuple[np.ndarray, list[np.ndarray]]:
    counts = gather((len(given.label), float(given.weight.sum())))
    n_rows, total = sum(n for n, _ in counts), sum(weight for _, weight in counts)
    bins = min(settings.bins, n_rows)
    share = min(1.0, max(settings.bins**2, LOOKED_AT) / n_rows)
    places = looked_at(len(given.label), share, part_seed(first_int(settings.seed), part))
    start, seen = 0, [np.empty((0, given.n_features))]
    for values in given.features():
        here = places[(places >= start) & (places < start + len(values))] - start
        seen.append(values[here])
        start += len(values)
    parts = gather((np.concatenate(seen), given.weight[places]))
    sample, weights = (np.concatenate(found) for found in zip(*parts))
    edges = [edges_of(column, weights, share, total, bins) for column in sample.T]
    found = np.empty((given.n_features, len(given.label)), dtype=np.uint8)
    start = 0
    for values in given.features():
        for feature, edge in enumerate(edges):
            found[feature, start : start + len(values)] = np.searchsorted(edge, values[:, feature])
        start += len(values)
    return found, edges


def trainer(settings: Settings, n_features: int, weighted: bool, folder: str):
    """For ``mapInArrow`` with a barrier: rows of features, label and weight in, the nodes of all
    trees out, from the first task.  Nothing comes out if the tasks do not share the folder."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        part, given = context.partitionId(), Input(batches, n_features)
        gather = Exchange(context, folder)
        if not gather.shared or not sum(gather(len(given.label))):
            return
        bins, edges = binned(given, settings, part, gather)
        label = 2.0 * given.label - 1.0 if settings.logistic else given.label
        rows = Rows(bins, edges, given.weight if weighted else None, gather)
        draws = Draws(len(label))
        margin, found = np.zeros(len(label)), []
        for number in range(settings.trees):
            target = residuals(margin, label, settings.logistic) if number else label
            rows.begin(target, draws(settings.seed + number + part + 1) < settings.share)
            nodes = grown(rows, settings.depth)
            margin += np.array([node.value for node in nodes])[rows.at] * (settings.step if number else 1.0)
            if not part:
                found += saved(nodes, edges, number)
        names = [column.split()[0] for column in SAVED.split(", ")]
        if found:
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*found))), schema=SCHEMA)

    return train


SCHEMA = pa.schema(
    [
        ("tree", pa.int32()), ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()),
        ("stats", pa.list_(pa.float64())), ("count", pa.int64()), ("gain", pa.float64()), ("left", pa.int32()),
        ("right", pa.int32()), ("feature", pa.int32()), ("edge", pa.float64()),
    ]
)
