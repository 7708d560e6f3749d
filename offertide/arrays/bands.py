"""Curves of bootstrap resamples, held as how often each replicate drew each place of the ranking.

Places are cut into blocks. A block holds a count per replicate and place, and the rows of each strategy at its places.
Curves start from the sums and maxima of the blocks before, and a stretch of points takes from each replicate those
blocks that its points lie in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from offertide.arrays.draws import uniforms

MEASURES = ("nt", "ct", "cc", "pt")
"""What is summed along a curve, besides the rows themselves."""


@dataclass(frozen=True)
class Shape:
    strategies: tuple[str, ...]
    replicates: int
    rows: int
    block: int
    """Places of a block."""
    stretch: int
    """Points of a stretch."""
    seed: int
    draws_per_task: int
    tails: tuple[float, float]

    @property
    def sums(self) -> tuple[int, int, int]:
        return len(self.strategies), self.replicates, 1 + len(MEASURES)


def drawn(shape: Shape) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task numbers to (block, codes): the places that a run of draws hit, as replicate and place in the block."""
    n, each = shape.rows, shape.replicates * shape.block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column(0).to_pylist():
                at, end, found = task * shape.draws_per_task, min((task + 1) * shape.draws_per_task, n * shape.replicates), []
                while at < end:
                    replicate, first = divmod(at, n)
                    count = min(end - at, n - first)
                    place = np.floor(uniforms(shape.seed, "resample", replicate + 1, first, count) * float(n)).astype(np.int64)
                    block, inside = np.divmod(place, shape.block)
                    found.append(block * each + (replicate * shape.block + inside))
                    at += count
                block, code = np.divmod(np.sort(np.concatenate(found)), each)
                blocks, starts = np.unique(block, return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blocks), pa.array([c.astype(np.uint32).tobytes() for c in np.split(code, starts[1:])], pa.binary())], ["block", "codes"])

    return run


def packed(shape: Shape) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(block, codes) and (block, strategy, place, measures) of one block to a row with its counts, rows and sums."""
    names = {name: i for i, name in enumerate(shape.strategies)}

    def pack(draws: pa.Table, placed: pa.Table) -> pa.Table:
        block = placed.column("block")[0].as_py()
        codes = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(c, np.uint32) for c in draws.column("codes").to_pylist()]])
        counts = np.bincount(codes, minlength=shape.replicates * shape.block).reshape(shape.replicates, shape.block)
        inside = placed.column("place").to_numpy() - 1 - block * shape.block
        of = np.array([names[s] for s in placed.column("strategy").to_pylist()])
        rows = np.zeros((len(names), len(MEASURES), shape.block))
        for m, name in enumerate(MEASURES):
            rows[of, m, inside] = placed.column(name).to_numpy()
        sums = np.empty(shape.sums)
        sums[:, :, 0] = counts.sum(axis=1)
        sums[:, :, 1:] = counts.astype(np.float64) @ rows.transpose(0, 2, 1)
        small = counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32)
        return pa.table({"block": pa.array([block]), "counts": pa.array([small.tobytes()], pa.binary()), "rows": pa.array([rows.tobytes()], pa.binary()),
                         "sums": pa.array([sums.ravel()], pa.list_(pa.float64()))})

    return pack


class Block:
    """A packed block whose curves can be followed."""

    def __init__(self, shape: Shape, counts: bytes, rows: bytes, before: np.ndarray) -> None:
        kind = np.uint8 if len(counts) == shape.replicates * shape.block else np.uint32
        self.counts = np.frombuffer(counts, kind).reshape(shape.replicates, shape.block)
        self.rows = np.frombuffer(rows).reshape(len(shape.strategies), len(MEASURES), shape.block)
        self.before = before
        self.first = before[0, :, 0].astype(np.int64)  # points of each replicate before the block
        self.last = self.first + self.counts.sum(axis=1, dtype=np.int64)

    def places(self, replicate: int) -> np.ndarray:
        return np.repeat(np.arange(self.counts.shape[1]), self.counts[replicate])

    def curve(self, strategy: int, replicate: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gain and conversions at each of the replicate's points in the block, before any maximum."""
        n, nt, ct, cc, pt = self.before[strategy, replicate]
        treated, ct, cc, pt = (start + np.cumsum(row[places]) for start, row in zip((nt, ct, cc, pt), self.rows[strategy], strict=True))
        control = np.arange(n + 1, n + 1 + len(places)) - treated
        with np.errstate(divide="ignore", invalid="ignore"):
            conversions = ct - np.where(control > 0, cc * (treated / control), 0.0)
            gain = conversions * np.where(ct > 0, pt / ct, 0.0)
        return gain, conversions


def _dense(table: pa.Table, size: Sequence[int], empty: float) -> np.ndarray:
    out = np.full(int(np.prod(size)), empty)
    out[table.column("pos").to_numpy()] = table.column("before").fill_null(empty).to_numpy()
    return out.reshape(size)


def peaks(shape: Shape) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A packed block and its (pos, before) to the maxima of its curves and the stretches its points lie in."""

    def run(block: pa.Table, earlier: pa.Table) -> pa.Table:
        one = Block(shape, block.column("counts")[0].as_py(), block.column("rows")[0].as_py(), _dense(earlier, shape.sums, 0.0))
        found = np.full((len(shape.strategies), shape.replicates, 2), -np.inf)
        for r in range(shape.replicates):
            places = one.places(r)
            if len(places):
                for s in range(len(shape.strategies)):
                    found[s, r] = [c.max() for c in one.curve(s, r, places)]
        some = one.last > one.first
        lies = [range(one.first[some].min() // shape.stretch, (one.last[some].max() - 1) // shape.stretch + 1)] if some.any() else [range(0)]
        return pa.table({"block": block.column("block"), "peaks": pa.array([found.ravel()], pa.list_(pa.float64())),
                         "stretches": pa.array([list(x) for x in lies], pa.list_(pa.int64()))})

    return run


def bands(shape: Shape) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The packed blocks of a stretch and their (block, is_peak, pos, before) to the bands at its points."""

    def run(blocks: pa.Table, earlier: pa.Table) -> pa.Table:
        start = blocks.column("stretch")[0].as_py() * shape.stretch
        width = min(shape.stretch, shape.rows - start)
        of, is_peak, parts = earlier.column("block").to_numpy(), earlier.column("is_peak").to_numpy(), []
        for i, key in enumerate(blocks.column("block").to_pylist()):
            sums, tops = (earlier.filter(pa.array((of == key) & (is_peak == kind))) for kind in (False, True))
            one = Block(shape, blocks.column("counts")[i].as_py(), blocks.column("rows")[i].as_py(), _dense(sums, shape.sums, 0.0))
            parts.append((one, _dense(tops, (*shape.sums[:2], 2), -np.inf)))
        out = []
        for s in range(len(shape.strategies)):
            curves = np.empty((2, shape.replicates, width))
            for block, peak in parts:
                for r in np.flatnonzero((block.last > start) & (block.first < start + width) & (block.last > block.first)):
                    low, high = max(block.first[r], start), min(block.last[r], start + width)
                    for c, values in enumerate(block.curve(s, r, block.places(r))):
                        top = np.maximum.accumulate(values)[low - block.first[r]:high - block.first[r]]
                        np.maximum(top, max(peak[s, r, c], 0.0), out=curves[c, r, low - start:high - start])
            columns = {"strategy": pa.array([shape.strategies[s]] * width), "n": pa.array(np.arange(start + 1, start + width + 1))}
            for name, values in zip(("gain", "conversions"), curves, strict=True):
                ordered = values.T.copy()
                ordered.sort(axis=1)
                columns |= {f"{name}_{side}": pa.array(_percentile(ordered, q)) for side, q in zip(("lo", "hi"), shape.tails, strict=True)}
            out.append(pa.table(columns))
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(out)

    return run


def _percentile(ordered: np.ndarray, q: float) -> np.ndarray:
    """The percentile of each row, as Spark and the SQL interpolate it."""
    at = (ordered.shape[1] - 1) * q
    low, high = int(np.floor(at)), int(np.ceil(at))
    return ordered[:, low] if low == high else (high - at) * ordered[:, low] + (at - low) * ordered[:, high]
