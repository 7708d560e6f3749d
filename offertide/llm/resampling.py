"""Importance resampling towards a target corpus over hashed word n-grams.

Features are hashed by CRC-32 of their UTF-8 bytes. CRC is linear: a byte's contribution
depends only on the byte and its distance from the end of the feature. All features of a
batch are spans of one flat byte array, so their hashes are one table lookup per byte and
one bitwise_xor.reduceat over the spans, plus a constant for each length. Spans longer than the
table are cut into blocks, whose sums are folded one block after the other.

Bucket counts of the corpus and the target give each bucket a gain (the scaled log ratio of
smoothed shares); a document's weight is the sum of gains over its features, and a
Gumbel draw keyed by its id is added. The highest scores are the sample. Texts are read
twice, once to count and once to weigh; a task sends at most `buckets` counts.

Null and empty texts have no features and weight 0. Repeated rows have equal scores and take
successive ranks; null ids draw as the empty id and come last among ties. An empty
table gives an empty result, an empty target only smoothing. Texts are never cut; the memory of a
task grows with its longest text. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offertide.functions.ranked import numbered
from offertide.llm.common import slices, written

BATCH_BYTES = 1 << 21
BLOCK = 64
ROWS_PER_TASK = 1 << 20
_WORD = 0xFFFFFFFF
_CRC_POLYNOMIAL = 0xEDB88320  # fixed value: the reversed polynomial of CRC-32

# The bytes of words are digits, small letters and all bytes beyond ASCII.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


class PositionCrc:
    """CRC-32 of many spans of one byte array at once."""

    def __init__(self, block: int = BLOCK) -> None:
        self.block = max(4, block)
        byte = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            byte = np.where(byte & 1, byte >> 1 ^ np.uint32(_CRC_POLYNOMIAL), byte >> 1).astype(np.uint32)
        steps, constants = [byte], [np.uint32(_WORD)]
        for _ in range(self.block):
            constants.append(byte[constants[-1] & 255] ^ constants[-1] >> 8)
            steps.append(byte[steps[-1] & 255] ^ steps[-1] >> 8)
        self.table = np.stack(steps)  # distance from the end x byte
        self.constants = np.array(constants, np.uint32)  # what the starting value becomes, by length

    def spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """CRC of data[start:end] for each span; spans may overlap but are not empty."""
        if not len(start):
            return np.zeros(0, np.uint32)
        length = end - start
        blocks = -(-length // self.block)
        first = np.cumsum(blocks) - blocks  # first block of each span: the short one
        size = np.full(int(blocks.sum()), self.block)
        size[first] = length - (blocks - 1) * self.block
        ahead = np.cumsum(size) - size
        order = np.arange(int(size.sum())) - np.repeat(ahead, size)
        at = np.repeat(np.cumsum(length) - length, length)
        own = data[np.arange(len(at)) - at + np.repeat(start, length)]
        sums = np.bitwise_xor.reduceat(self.table[np.repeat(size, size) - 1 - order, own], ahead)
        state = sums[first] ^ self.constants[size[first]]
        long = np.flatnonzero(blocks > 1)
        step = 1
        while len(long):
            now = state[long]
            moved = sums[first[long] + step]
            for k in range(4):  # the state acts like four more bytes at the head of the block
                moved = moved ^ self.table[self.block - 1 - k, now >> 8 * k & 255]
            state[long] = moved
            step += 1
            long = long[blocks[long] > step]
        return state ^ np.uint32(_WORD)


def features(texts: list[bytes | None], crc: PositionCrc, most_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text of every run of 1 to `most_words` words, and the number of words of each text."""
    parts = [t.lower() if t else b"" for t in texts]  # bytes: A to Z only
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    edges = np.flatnonzero(np.diff(np.r_[False, _IN_WORD[data]].view(np.int8)))
    start, end = edges[0::2], edges[1::2]
    text_end = np.cumsum([len(p) + 1 for p in parts])
    owner = np.searchsorted(text_end, start, "right")
    hashes, owners = [crc.spans(data, start, end)], [owner]
    if most_words > 1 and len(start):
        size = end - start + 1  # words set side by side, one space behind each
        spaced_end = np.cumsum(size)
        at = np.repeat(spaced_end - size, size)
        own = np.repeat(start, size) + np.arange(len(at)) - at
        spaced = np.where(np.repeat(spaced_end, size) - 1 == np.arange(len(at)), 32, data[own]).astype(np.uint8)
        for n in range(2, most_words + 1):
            run = np.flatnonzero(owner[n - 1:] == owner[:len(owner) - n + 1])
            hashes.append(crc.spans(spaced, (spaced_end - size)[run], spaced_end[run + n - 1] - 1))
            owners.append(owner[run])
    return np.concatenate(hashes), np.concatenate(owners), np.bincount(owner, minlength=len(texts))


def _batches(batch: pa.RecordBatch):
    texts = batch.column("_text").cast(pa.binary()).to_pylist()
    for a, b in slices([len(t or b"") for t in texts], BATCH_BYTES):
        yield a, b, texts[a:b]


def bucket_counts(df: DataFrame, text_col: str = "text", most_words: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket."""

    def count(batches):
        crc, seen = PositionCrc(), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, texts in _batches(batch):
                seen += np.bincount(features(texts, crc, most_words)[0] % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["bucket", "n"])

    parts = df.select(F.col(text_col).alias("_text")).mapInArrow(count, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000, scale: int = 1000) -> np.ndarray:
    """Gain of each bucket, from two tables of bucket counts; `buckets` numbers on the driver."""
    counts = []
    for table in (corpus, target):
        own = np.zeros(buckets)
        for bucket, n in table.collect():  # at most `buckets` rows
            own[bucket] = n
        counts.append(own)
    s, t = counts
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(scale * np.log(ratio)).astype(np.int64)


def weighed(df: DataFrame, gain: np.ndarray, most_words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_words, n_features and weight of each row."""
    buckets = len(gain)
    schema = df.select(id_col).withColumns({c: F.lit(0).cast("long") for c in ("n_words", "n_features", "weight")}).schema
    own_id = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def weigh(batches):
        crc = PositionCrc()
        for batch in batches:
            for a, b, texts in _batches(batch):
                hashes, owner, words = features(texts, crc, most_words)
                n = np.bincount(owner, minlength=b - a)
                order = np.argsort(owner, kind="stable")
                total = np.r_[0, np.cumsum(gain[hashes[order] % np.uint32(buckets)])]
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(a, b - a), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)),
                     pa.array(total[ends] - total[ends - n])], names=schema.names)

    return own_id.mapInArrow(weigh, schema)


def resample(df: DataFrame, target: DataFrame, share: int = 10, most_words: int = 1, buckets: int = 10_000,
             least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text") -> DataFrame:
    """Id, n_features, weight, score and rank of every row; rank is null for rows that aren't drawn.

    Of the N rows with at least `least_words` words, floor(share * N / 100) are drawn.
    """
    gain = gains(bucket_counts(df, text_col, most_words, buckets), bucket_counts(target, target_text_col, most_words, buckets), buckets)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(
        weighed(df, gain, most_words, id_col, text_col).withColumn("score", F.col("weight") + noise)
        .withColumn("_row", F.monotonically_increasing_id()), "weights")  # stored, so row numbers stay
    n = scored.where(F.col("n_words") >= least_words).count()
    wanted = share * n // 100
    out = [id_col, "n_features", "weight", "score"]
    fit = numbered(scored.where(F.col("n_words") >= least_words), [F.desc("score"), F.asc_nulls_last(id_col), F.asc("_row")],
                   name="rank", partitions=max(1, -(-n // ROWS_PER_TASK)))
    fit = fit.select(*out, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return fit.unionByName(scored.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank")))
