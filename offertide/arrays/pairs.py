"""Boosted trees over every pair of a left row (a customer) and a right row (an offer).

A test of a tree that fails rules out the leaves on its left, and the first leaf that is still open is the one
that is reached. Each test reads a slot of one side only, so the leaves that a side leaves open are found once per
row of that side. A pair then needs no test: its leaf is the first one that both sides leave open, and it is looked up
once for all left rows that leave the same leaves open.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Collection, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

PAIRS = 250_000
"""Pairs that are held in memory at once."""
MOST_LEAVES = 64
_ALL = np.uint64(2**64 - 1)
_TREE = re.compile(r"Tree \d+ \(weight (\S+)\):")
_TEST = re.compile(r"If \(feature (\d+) (?:<= (\S+)|in \{(.*)\})\)")


@dataclass
class Tests:
    """Tests of one tree: row values of `slots` at most `cuts` or, at the places in `sets`, among given values;
    `kept` are the leaves left open where a test fails."""

    slots: np.ndarray
    cuts: np.ndarray
    kept: np.ndarray
    sets: list[tuple[int, np.ndarray]]

    def open_leaves(self, x: np.ndarray) -> np.ndarray:
        """The open leaves of rows, as bits; `x` is slots by rows."""
        read = x[self.slots]
        passed = read <= self.cuts[:, None]
        for i, values in self.sets:
            passed[i] = np.isin(read[i], values)
        return np.bitwise_and.reduce(np.where(passed, _ALL, self.kept[:, None]), axis=0)

    def of(self, slots: Collection[int]) -> "Tests":
        """Only the tests that read one of `slots`."""
        mine = np.flatnonzero(np.isin(self.slots, list(slots)))
        place = {int(i): k for k, i in enumerate(mine)}
        return Tests(self.slots[mine], self.cuts[mine], self.kept[mine], [(place[i], v) for i, v in self.sets if i in place])


def read_trees(text: str) -> list[tuple[Tests, np.ndarray]] | None:
    """(tests, weighted leaves) of each tree of Spark's description of a boosted model, which names every number in
    full; None if a tree has more leaves than there are bits."""
    heads = list(_TREE.finditer(text))
    ends = [h.start() for h in heads[1:]] + [len(text)]
    found = [_read_tree(text[h.end():end].split("\n"), float(h[1])) for h, end in zip(heads, ends, strict=True)]
    return None if any(len(leaves) > MOST_LEAVES for _, leaves in found) else found


def _read_tree(lines: Sequence[str], weight: float) -> tuple[Tests, np.ndarray]:
    tests: list[list] = []  # slot, cut, values, first leaf on the left, first one on the right
    leaves: list[float] = []
    above: list[list] = []  # tests whose left side is being read
    for line in map(str.strip, lines):
        if line.startswith("If"):
            slot, cut, values = _TEST.match(line).groups()
            above.append([int(slot), np.nan if cut is None else float(cut),
                          None if values is None else np.array([float(v) for v in values.split(",") if v]), len(leaves), 0])
            tests.append(above[-1])
        elif line.startswith("Else"):
            above.pop()[4] = len(leaves)
        elif line.startswith("Predict:"):
            leaves.append(float(line.removeprefix("Predict:")))
    kept = [(2**64 - 1) ^ ((1 << right) - (1 << left)) & (2**64 - 1) for *_, left, right in tests]
    return Tests(np.array([t[0] for t in tests], np.int64), np.array([t[1] for t in tests], np.float64), np.array(kept, np.uint64),
                 [(i, t[2]) for i, t in enumerate(tests) if t[2] is not None]), weight * np.array(leaves)


class PairForest:
    """The trees of one model, with the right rows already read."""

    def __init__(self, trees: Sequence[tuple[Tests, np.ndarray]], left: Collection[int], right: Collection[int],
                 right_rows: np.ndarray) -> None:
        self.size = len(right_rows)
        x = np.ascontiguousarray(right_rows.T)
        self.trees = [(tests.of(left), *np.unique(tests.of(right).open_leaves(x), return_inverse=True), leaves)
                      for tests, leaves in trees]

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Weighted leaves summed over the trees, left rows by right rows; `x` is slots by left rows."""
        total = np.zeros((x.shape[1], self.size))
        one = np.empty_like(total)
        for tests, right, place, leaves in self.trees:
            left, which = np.unique(tests.open_leaves(x), return_inverse=True)
            both = left[:, None] & right
            first = np.frexp((both & (~both + np.uint64(1))).astype(np.float64))[1] - 1
            total += np.take(leaves[first][:, place], which, axis=0, out=one)
        return total


@dataclass
class Group:
    """Right rows of one type: their places, the weight of tau_c and the two effect models."""

    places: np.ndarray
    share: float
    treated: PairForest
    control: PairForest


@dataclass
class PairScores:
    """All that scores the pairs of a batch of left rows."""

    ids: list[str]
    types: list[str]
    groups: list[Group]
    conversion: PairForest

    def score(self, effect_rows: np.ndarray, conversion_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """uplift, uncertainty and p_convert, left rows by right rows."""
        x, y = np.ascontiguousarray(effect_rows.T), np.ascontiguousarray(conversion_rows.T)
        uplift, uncertainty = np.empty((x.shape[1], len(self.ids))), np.empty((x.shape[1], len(self.ids)))
        for g in self.groups:
            treated, control = g.treated.sums(x), g.control.sums(x)
            uplift[:, g.places] = g.share * control + (1 - g.share) * treated
            uncertainty[:, g.places] = np.abs(treated - control)
        with np.errstate(over="ignore"):
            chance = 1 - 1 / (1 + np.exp(2 * self.conversion.sums(y)))
        return uplift, uncertainty, chance


def packed(scores: PairScores) -> bytes:
    """With the code of its classes, as a broadcast value is unpacked by executors that have no copy of this package."""
    return cloudpickle.dumps(scores)


def scorer(held) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (account_id, effect slots, conversion slots) to a row per pair; `held` is the broadcast of `packed` scores."""

    def matrix(column: pa.ListArray) -> np.ndarray:
        return column.flatten().to_numpy().reshape(len(column), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = pickle.loads(held.value)
        ids, types = pa.array(scores.ids, pa.string()), pa.array(scores.types, pa.string())
        step = max(1, PAIRS // max(1, len(scores.ids)))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                found = scores.score(matrix(batch.column(1)), matrix(batch.column(2)))
                left = pa.array(np.repeat(np.arange(batch.num_rows), len(ids)))
                right = pa.array(np.tile(np.arange(len(ids)), batch.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(left), ids.take(right), types.take(right), *[pa.array(f.ravel()) for f in found]],
                    ["account_id", "offer_id", "offer_type", "uplift", "uncertainty", "p_convert"])
        pa.default_memory_pool().release_unused()

    return run
