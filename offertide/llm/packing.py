"""Packing documents into sequences with shortest-pack-first over the length histogram.

A document's ids, closed by an end id, are cut into pieces of at most `size` ids. Only the
histogram of piece lengths, at most `size` numbers, is packed: lengths go longest first
into the pattern with the most room, and patterns carry counts. Pieces then find their
sequence by rank: the k-th piece of a length takes the k-th place that the patterns have
for that length. Ranks are counted within each task while tokenising and shifted by the
counts of earlier tasks, so no length, however common, meets in one task.

Null and empty texts are just the end id. Repeated rows are packed as they stand. An
empty table gives an empty result. Very long texts give many pieces. Other columns are
not looked at.
"""

from __future__ import annotations

import heapq
import itertools
import re
import struct
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offertide.llm.common import sparing, written

SIZE = 2048
END_ID = 1
LONG_BLANK = 4096
"""White space in a row from which a chunk goes to the full tokenizer: the quick one gives up on runs of a million."""
CACHED_CHUNKS = 200_000
"""Chunks of text kept with their ids by each Python worker (about 40 MB)."""

# Between two characters that aren't white space, one space always begins a new token, so
# a text may be cut there and the chunks tokenised on their own.
_BLANKS = re.compile(r"\s{%d}" % LONG_BLANK)
_CUT = re.compile(r"(?<=\S) (?=\S)")


class ChunkTokenizer:
    """Ids of a text as little-endian unsigned 32-bit bytes, remembering chunks between spaces.

    Chunks that are new are encoded with the vocabulary's merge ranks when they are of plain
    Latin letters, where every reader of the vocabulary agrees on the word pattern; any
    other chunk, any with a long run of white space, and any text with a special mark goes to the
    full tokenizer.
    """

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer
        from tiktoken import Encoding

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in text): k for text, k in spec["model"]["vocab"].items() if text not in self.special}
        fast = Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.fast = fast
        self.known = _Known(self._ids)
        self.marks = {mark: self._code(mark) for mark in ".,:;!?"}

    def _ids(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _BesideSpace
        if chunk[-1] in ".,:;!?" and chunk[-2:-1].isalpha() and chunk.isascii():  # a word always ends there
            return self.known[chunk[:-1]] + self.marks[chunk[-1]]
        return self._code(" " + chunk)

    def _code(self, chunk: str) -> bytes:
        plain = (chunk.isascii() or max(chunk) < _PLAIN) and not (len(chunk) > LONG_BLANK and _BLANKS.search(chunk))
        ids = self.fast(chunk) if plain else self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if any(mark in text for mark in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self.known.bound()
        try:  # plain splitting is right unless white space stands next to a space
            first, *rest = text.split(" ")
            return self._code(first) + b"".join(map(self.known.__getitem__, rest))
        except _BesideSpace:
            first, *rest = _CUT.split(text)
            return self._code(first) + b"".join([self._code(" " + chunk) for chunk in rest])


class _BesideSpace(Exception):
    pass


class _Known(dict):
    """Codes of chunks; once full, only the chunks met first, the common ones, are kept."""

    def __init__(self, code) -> None:
        super().__init__()
        self.code = code

    def __missing__(self, chunk: str) -> bytes:
        out = self[chunk] = self.code(chunk)
        return out

    def bound(self) -> None:
        if len(self) > CACHED_CHUNKS:
            for chunk in list(itertools.islice(self, CACHED_CHUNKS // 4, None)):
                del self[chunk]


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


_PLAIN = "\u0250"  # up to the Latin letters with marks

# Fixed value: the word pattern of the byte-level vocabulary.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def pack_histogram(histogram: Mapping[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (count, [(length, copies), ...]) that hold every piece of the histogram.

    Shortest-pack-first: the longest length goes to the packs with the most room, one
    piece each, and packs are opened when none has room. Packs alike are one pattern with a
    count, which is split when only some of them get a piece.
    """
    patterns: list[list] = []
    room: list[tuple[int, int]] = []  # a heap of (-room, pattern)

    def add(count: int, runs: list[tuple[int, int]], left: int) -> None:
        patterns.append([count, runs])
        heapq.heappush(room, (-left, len(patterns) - 1))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            if not room or -room[0][0] < length:
                each = size // length
                if n >= each:
                    add(n // each, [(length, each)], size - length * each)
                if n % each:
                    add(1, [(length, n % each)], size - length * (n % each))
                break
            left, k = heapq.heappop(room)
            count, runs = patterns[k]
            # As many pieces as keep these packs the shortest, the same number in each.
            second = -room[0][0] if room else 0
            times = max(1, min((-left - second) // length, -left // length, n // count))
            if n < count:
                patterns[k] = [count - n, runs]
                heapq.heappush(room, (left, k))
                add(n, _with(runs, length, 1), -left - length)
                n = 0
            else:
                patterns[k] = [count, _with(runs, length, times)]
                heapq.heappush(room, (left + length * times, k))
                n -= count * times
    return [(count, runs) for count, runs in patterns]


def _with(runs: list[tuple[int, int]], length: int, copies: int) -> list[tuple[int, int]]:
    if runs and runs[-1][0] == length:
        return [*runs[:-1], (length, runs[-1][1] + copies)]
    return [*runs, (length, copies)]


class Places:
    """Maps (length, rank) to (sequence, offset). At most a few entries for each length."""

    def __init__(self, patterns: list[tuple[int, list[tuple[int, int]]]]) -> None:
        rows, base = [], 0
        for count, runs in patterns:
            offset = 0
            for length, copies in runs:
                rows.append((length, count, copies, base, offset))
                offset += length * copies
            base += count
        rows.sort(key=lambda r: r[0])
        got = np.array(rows or [(0, 1, 1, 0, 0)], np.int64)
        self.length, self.count, self.base, self.offset = got[:, 0], got[:, 1], got[:, 3], got[:, 4]
        pieces = got[:, 1] * got[:, 2]
        before = np.cumsum(pieces) - pieces
        new = np.r_[True, self.length[1:] != self.length[:-1]]
        self.first = before - before[new][np.cumsum(new) - 1]  # rank of its first piece in its length
        self.starts = np.flatnonzero(new)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros(len(length), np.int64)
        lengths = self.length[self.starts]
        which = np.searchsorted(lengths, length)
        order = np.argsort(which, kind="stable")
        bounds = np.searchsorted(which[order], np.arange(len(lengths) + 1))
        ends = np.r_[self.starts[1:], len(self.length)]
        for k in np.unique(which):
            rows = order[bounds[k]:bounds[k + 1]]
            first = self.first[self.starts[k]:ends[k]]
            out[rows] = self.starts[k] + np.searchsorted(first, rank[rows], "right") - 1
        inside = rank - self.first[out]
        return self.base[out] + inside % self.count[out], self.offset[out] + inside // self.count[out] * length


def pieces(df: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Stored pieces: _task and _rank number the pieces of a length within the task that made them."""
    id_type = df.schema[id_col].dataType
    fields = [T.StructField("_id", id_type), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
              T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
              T.StructField("_task", T.LongType()), T.StructField("_rank", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = [f.name for f in fields]
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        from pyspark import TaskContext

        task, coder, seen = TaskContext.get().partitionId(), None, np.zeros(size + 1, np.int64).tolist()
        for batch in batches:
            coder = coder or ChunkTokenizer(tokenizer)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                rows = []
                for key, raw in zip(part.column("_id").to_pylist(), map(coder.encode, texts), strict=True):
                    raw += end
                    total = len(raw) // 4
                    for start in range(0, total, size):
                        n = min(size, total - start)
                        own = raw[4 * start:4 * (start + n)]
                        rows.append((key, start, n, zlib.crc32(own), total, task, seen[n],
                                     *([np.frombuffer(own, "<i4")] if with_ids else [])))
                        seen[n] += 1
                columns = list(zip(*rows, strict=True)) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in fields]
    source = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return written(source.mapInArrow(sparing(cut), T.StructType(fields)), "pieces")


def place(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to stored pieces."""
    counts = written(cut.groupBy("_task", "length").agg(F.count("*").alias("_n")), "piece-counts")
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # at most `size` rows
    places = Places(pack_histogram(histogram, size))
    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_task", "length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    ranked = cut.join(shifts, ["_task", "length"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_task", "_before")
    kept = [c for c in cut.columns if c not in ("_task", "_rank")]
    schema = T.StructType([*[cut.schema[c] for c in kept],
                           T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def find(batches):
        for batch in batches:
            sequence, offset = places.find(batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(sparing(find), schema)


def pack(df: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    placed = place(pieces(df, tokenizer, size, end_id, id_col, text_col, with_ids), size)
    return placed.withColumnRenamed("_id", id_col)


def sequences(packed: DataFrame, size: int = SIZE, pad_id: int = 0) -> DataFrame:
    """One row per sequence of pieces packed `with_ids`: its ids, padded, and where pieces begin.

    A sequence whose length is a power of two isn't padded. A group has at most `size` ids.
    """
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = packed.groupBy("sequence_id").agg(own.alias("p"), F.sum("length").alias("n"))
    power = F.expr("(n & (n - 1)) = 0")
    pad = F.array_repeat(F.lit(pad_id), (F.when(power, 0).otherwise(F.lit(size) - F.col("n"))).cast("int"))
    return rows.select("sequence_id", F.concat(F.flatten("p.ids"), pad).alias("ids"),
                       F.col("p.offset").alias("starts"), F.col("n").alias("length"))
