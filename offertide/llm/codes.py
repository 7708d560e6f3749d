"""Product codes of vectors, with codebooks fitted by k-means under adaptive distance bounds.

Vectors of integers are cut into equal consecutive parts, each with a codebook of its own. Between
rounds every row keeps, for each part, its nearest entry and the next b entries in order of distance
with a lower bound each, one outer lower bound for all other entries, and an upper bound
for its own. When the entries move, upper bounds grow and lower bounds shrink by how far; a row
whose upper bound stays below all others keeps its entry without a distance being computed. Otherwise
its kept entries are measured in integers, and only if the outer bound can't exclude the
rest, all entries are. Bounds are rounded outwards, so what they decide is certain, and ties are decided
by integers alone. b starts at FIRST_KEPT and follows what rows needed, by the rule of `next_kept`.

Each round stores the rows with their bounds once and drops the table before it; then tasks send
one partial sum per entry, and only the codebooks pass through the driver.

Rows whose vector is null, or holds null or non-finite components, take no part. Components become
floor(scale * x), clamped to +-2^24 so that every sum fits a long. Vectors shorter than the longest, or whose
parts would be unequal, count as filled up with zeros. Repeated rows are rows like any other. Null ids come
last among the first entries; equal ids are ordered by vector. With fewer rows than entries
the codebooks are that much smaller, and an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offertide.functions.storage import discard
from offertide.llm.common import attach_groups, slices, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
CLAMP = 1 << 24
FIRST_KEPT = 8
TOO_MANY = 0.01
"""Share of parts that may need all entries measured before more of the nearest are kept."""
BATCH_CELLS = 1 << 20
_FAR = np.iinfo(np.int64).max
_OUT, _IN = 1 + 1e-6, 1 - 1e-6  # outward rounding, wider than that of 32-bit floats


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 1 << 53:  # all values are whole numbers that doubles hold
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    out = np.empty((len(x), len(book)), np.int64)
    for j, entry in enumerate(book):
        out[:, j] = ((x - entry) ** 2).sum(1)
    return out


class Bounds:
    """Bounds of a batch of rows for one part: near (own entry first), upper, lower and outer."""

    def __init__(self, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, outer: np.ndarray) -> None:
        self.near, self.upper, self.lower, self.outer = near, upper, lower, outer

    @classmethod
    def measured(cls, x: np.ndarray, book: np.ndarray, kept: int) -> "Bounds":
        """Bounds from the distances to all entries."""
        d = squared(x, book)
        rows = np.arange(len(x))
        own = d.argmin(1)  # the lowest index among ties
        upper = np.sqrt(d[rows, own].astype(np.float64)) * _OUT
        d[rows, own] = -1
        b = min(kept, len(book) - 1)
        if b + 1 < len(book):
            near = np.argpartition(d, b + 1, axis=1)[:, :b + 2]
        else:
            near = np.broadcast_to(np.arange(len(book)), d.shape)
        own_d = np.take_along_axis(d, near, 1)
        order = np.argsort(own_d, axis=1, kind="stable")
        near, own_d = np.take_along_axis(near, order, 1), np.take_along_axis(own_d, order, 1)
        lower = np.sqrt(np.maximum(own_d[:, 1:], 0).astype(np.float64)) * _IN
        outer = lower[:, b].copy() if b + 1 < len(book) else np.full(len(x), np.inf)
        return cls(*_padded(near[:, :b + 1], lower[:, :b], kept, upper, outer))

    def moved(self, moves: np.ndarray) -> None:
        """Loosen the bounds after each entry has moved by at most `moves`."""
        self.upper = (self.upper + moves[self.near[:, 0]]) * (1 + 1e-12)
        self.lower = np.maximum(self.lower - moves[self.near[:, 1:]], 0) * (1 - 1e-12)
        self.outer = np.maximum(self.outer - moves.max(initial=0), 0) * (1 - 1e-12)

    def settle(self, x: np.ndarray, book: np.ndarray, kept: int) -> np.ndarray:
        """Make near[:, 0] the nearest entry again; how many kept entries each row needed, 0 to kept + 1."""
        b = self.lower.shape[1]
        needed = np.zeros(len(x), np.int64)
        least = np.minimum(self.lower.min(axis=1, initial=np.inf), self.outer)
        open_rows = np.flatnonzero(self.upper >= least)
        # First the distance to the own entry alone.
        own = ((x[open_rows] - book[self.near[open_rows, 0]]) ** 2).sum(1)
        self.upper[open_rows] = np.sqrt(own.astype(np.float64)) * _OUT
        open_rows = open_rows[self.upper[open_rows] >= least[open_rows]]
        if len(open_rows):
            near, lower = self.near[open_rows], self.lower[open_rows]
            filled = np.isinf(lower)  # places without an entry
            d = np.empty(near.shape, np.int64)
            for z in range(b + 1):
                d[:, z] = ((x[open_rows] - book[near[:, z]]) ** 2).sum(1)
            d[:, 1:][filled] = _FAR
            order = np.lexsort((near, d), axis=1)
            near, d = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)
            root = np.sqrt(d.astype(np.float64))
            places = np.where(lower <= self.upper[open_rows, None], np.arange(1, b + 1), 0)
            needed[open_rows] = places.max(axis=1, initial=0)
            self.near[open_rows], self.upper[open_rows] = near, root[:, 0] * _OUT
            self.lower[open_rows] = np.where(d[:, 1:] == _FAR, np.inf, root[:, 1:] * _IN)
            rest = open_rows[self.upper[open_rows] >= self.outer[open_rows]]
            if len(rest):
                needed[rest] = b + 1
                full = Bounds.measured(x[rest], book, b)
                self.near[rest], self.upper[rest] = full.near, full.upper
                self.lower[rest], self.outer[rest] = full.lower, full.outer
        if kept < b:  # the bounds given up count as outer ones
            self.outer = np.minimum(self.outer, self.lower[:, kept:].min(axis=1, initial=np.inf))
            self.near, self.lower = self.near[:, :kept + 1], self.lower[:, :kept]
        elif kept > b:
            self.near, self.upper, self.lower, self.outer = _padded(self.near, self.lower, kept, self.upper, self.outer)
        return needed


def _padded(near, lower, kept, upper, outer):
    """Places without an entry repeat the own one, infinitely far."""
    more = kept - lower.shape[1]
    if more > 0:
        near = np.concatenate([near, np.repeat(near[:, :1], more, 1)], 1)
        lower = np.concatenate([lower, np.full((len(near), more), np.inf)], 1)
    return near, upper, lower, outer


def next_kept(kept: int, needed: Mapping[int, int], entries: int) -> int:
    """Entries to keep next round, from how many parts needed how many: entries/64 to entries/8."""
    least, most, total = max(1, entries // 64), max(1, entries // 8), sum(needed.values())
    if sum(n for k, n in needed.items() if k > kept) > TOO_MANY * total:
        return min(most, 2 * kept)
    for b in range(least, kept):
        if sum(n for k, n in needed.items() if k > b) <= TOO_MANY * total:
            return b
    return max(least, min(kept, most))


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel(), kind))


class Round:
    """What the tasks of one round need: the codebooks before and now, and the bounds to keep."""

    def __init__(self, books: np.ndarray, before: np.ndarray | None, had: int, kept: int, width: int) -> None:
        self.books, self.before, self.had, self.kept, self.width = books, before, had, kept, width

    def settled(self, batch: pa.RecordBatch):
        """Vectors by part and their settled bounds, a bounded number of rows at a time."""
        parts, entries = self.books.shape[:2]
        per_row = entries + parts * self.width
        for a, b in slices([per_row] * batch.num_rows, BATCH_CELLS):
            rows = batch.slice(a, b - a)
            x = _vectors(rows.column("v"), parts * self.width).reshape(b - a, parts, self.width)
            own, needed = [], np.zeros((b - a, parts), np.int64)
            if self.before is not None:
                near = _vectors(rows.column("near"), parts * (self.had + 1)).reshape(b - a, parts, -1)
                bounds = rows.column("bounds").flatten().to_numpy().astype(np.float64).reshape(b - a, parts, -1)
            for p in range(parts):
                if self.before is None:
                    own.append(Bounds.measured(x[:, p], self.books[p], self.kept))
                    continue
                own.append(Bounds(near[:, p].copy(), bounds[:, p, 0].copy(), bounds[:, p, 1:-1].copy(), bounds[:, p, -1].copy()))
                gap = ((self.books[p] - self.before[p]) ** 2).sum(1)
                own[p].moved(np.sqrt(gap.astype(np.float64)) * (1 + 1e-12))
                needed[:, p] = own[p].settle(x[:, p], self.books[p], self.kept)
            yield rows, x, own, needed


def _assigned(table: DataFrame, this: Round, id_type: T.DataType, label_type: T.DataType) -> DataFrame:
    """Stored rows with their vectors, bounds, nearest entries and the kept entries they needed."""
    ints, floats = T.ArrayType(T.IntegerType()), T.ArrayType(T.FloatType())
    schema = T.StructType([T.StructField("id", id_type), T.StructField("label", label_type), T.StructField("v", ints),
                           T.StructField("own", ints), T.StructField("near", ints), T.StructField("bounds", floats),
                           T.StructField("needed", ints)])

    def assign(batches):
        for batch in batches:
            for rows, _, own, needed in this.settled(batch):
                near = np.stack([o.near for o in own], 1)
                bounds = np.stack([np.column_stack([o.upper * _OUT, o.lower * _IN, o.outer * _IN]) for o in own], 1)
                n = len(near)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), rows.column("label"), rows.column("v"), _lists(near[:, :, 0].astype(np.int32), pa.int32()),
                     _lists(near.reshape(n, -1).astype(np.int32), pa.int32()),
                     _lists(bounds.reshape(n, -1).astype(np.float32), pa.float32()), _lists(needed.astype(np.int32), pa.int32())],
                    names=schema.names)

    return written(table.mapInArrow(assign, schema), "codes-round")


def _moved(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks whose used entries are the floored means of their parts."""
    parts, entries, width = books.shape

    def add(batches):
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _vectors(batch.column("v"), parts * width).reshape(batch.num_rows, parts, width)
            own = _vectors(batch.column("own"), parts)
            for p in range(parts):
                order = np.argsort(own[:, p], kind="stable")
                counts[p] += np.bincount(own[:, p], minlength=entries)
                if len(order):
                    used, start = np.unique(own[order, p], return_index=True)
                    sums[p, used] += np.add.reduceat(x[order, p], start, axis=0)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(entry), pa.array(counts[part, entry]), _lists(sums[part, entry], pa.int64())],
            names=["part", "entry", "n", "sums"])

    partial = table.select("v", "own").mapInArrow(add, "part long, entry long, n long, sums array<long>")
    whole = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j]) for j in range(width)]).alias("sums"))
    out = books.copy()
    for part, entry, n, sums in whole.collect():  # at most parts * entries rows
        out[part, entry] = np.array(sums, np.int64) // n
    return out


def whole_numbers(column: str, scale: int) -> F.Column:
    """floor(scale * x) of each component within +-CLAMP, or null if the vector takes no part."""
    x = F.col(column)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = lambda v: F.floor(F.greatest(F.lit(-float(CLAMP)), F.least(F.lit(float(CLAMP)), v.cast("double") * scale)))
    return F.when(x.isNotNull() & sound, F.transform(x, lambda v: whole(v).cast("int")))


def fit_codes(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
              id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Stored id, label, codes (an index per part) and error of each row, and the codebooks."""
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole_numbers(vector_col, scale).alias("v")).where("v IS NOT NULL")
    first = rows.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts)
    start = np.zeros((len(first), parts * width), np.int64)
    for k, (_, v) in enumerate(first):
        start[k, :len(v)] = v
    books = np.ascontiguousarray(start.reshape(len(first), parts, width).transpose(1, 0, 2))
    id_type, label_type = rows.schema["id"].dataType, rows.schema["label"].dataType
    had = kept = max(1, min(FIRST_KEPT, entries // 8))
    table, before = rows, None
    for _ in range(rounds if first else 0):
        stored = _assigned(table, Round(books, before, had, kept, width), id_type, label_type)
        if before is not None:
            discard(table)
        had = kept
        if before is not None:
            needed = stored.select(F.explode("needed").alias("k")).groupBy("k").count().collect()  # at most kept + 2 rows
            kept = next_kept(kept, {k: n for k, n in needed}, entries)
        table, before, books = stored, books, _moved(stored, books)
    this = Round(books, before, had, kept, width)
    schema = T.StructType([T.StructField("id", id_type), T.StructField("label", label_type),
                           T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])

    def finish(batches):
        for batch in batches:
            for part_rows, x, own, _ in this.settled(batch):
                codes = np.stack([o.near[:, 0] for o in own], 1)
                error = sum(((x[:, p] - books[p][codes[:, p]]) ** 2).sum(1) for p in range(parts))
                yield pa.RecordBatch.from_arrays(
                    [part_rows.column("id"), part_rows.column("label"), _lists(codes.astype(np.int32), pa.int32()), pa.array(error, pa.int64())],
                    names=schema.names)

    if not first:
        return rows.sparkSession.createDataFrame([], schema), books
    coded = written(table.mapInArrow(finish, schema), "codes")
    if before is not None:
        discard(table)
    return coded, books


def code_report(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
                id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Id, code, error, label_error and a digest of all codebooks for every row that takes part."""
    coded, books = fit_codes(df, parts, entries, rounds, scale, id_col, vector_col, label_col)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    digits = max(2, len(f"{entries - 1:x}"))
    keyed = coded.withColumns({"_label": F.coalesce(F.col("label").cast("string"), F.lit("")), "_none": F.col("label").isNull()})
    groups = written(keyed.groupBy("_label", "_none").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "label-errors")
    total = groups.agg(F.sum("_n")).first()[0] or 0
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), digits, "0")), "")
    return attach_groups(keyed, groups, ["_label", "_none"], "_n", total).select(
        F.col("id").alias(id_col), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
