"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offertide.functions.storage import written

# The white space that separates words (space, tab to carriage return).
SPACES = r"[\x20\x09-\x0D]+"
NO_SPACES = r"[^\x20\x09-\x0D]+"

BROADCAST_ROWS = 20_000
"""Most rows of a table that is sent to every executor; larger ones are joined by shuffle."""

HOT_SHARE = 1000
"""A group is hot if it holds more than 1/HOT_SHARE of the rows, so there are fewer than HOT_SHARE."""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sparing(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """`work` over batches, giving the memory that Arrow holds for reuse back after each batch.

    Python workers outlive their tasks, so what one keeps is missing to the stages that follow.
    """

    def run(batches):
        def each():
            for batch in batches:
                yield batch
                del batch
                pa.default_memory_pool().release_unused()

        yield from work(each())
        pa.default_memory_pool().release_unused()

    return run


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def attach_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, total: int) -> DataFrame:
    """Left join of `rows` with one row per group; `groups` must be stored and its keys not null.

    `size` is the number of `rows` in the group and `total` that of all rows. Groups are
    broadcast whole while there are few. Beyond that only the hot ones are: by their
    definition fewer than HOT_SHARE, whatever the size of the data. What is left shuffles,
    and none of its keys holds more than total / HOT_SHARE rows.
    """
    keys = list(keys)
    if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), keys, "left")
    is_hot = F.col(size) * HOT_SHARE > F.lit(total)
    hot, cold = groups.where(is_hot), groups.where(~is_hot)
    with_hot = rows.join(F.broadcast(hot), keys, "inner")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, "left")
    return with_hot.unionByName(rest)


def connected(edges: DataFrame, rounds: int | None = None, most_rounds: int = 60) -> DataFrame:
    """(node, root) with the smallest node of each component, for the nodes of `edges(a, b)`.

    Alternating large-star and small-star steps, which keep the number of edges and
    converge in about the logarithm of the longest path. Every round is stored. With
    `rounds` it stops there: nodes with equal roots are connected, but not the reverse.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .where("u <> v").distinct(), "edges")
    mark = None
    for step in range(rounds or most_rounds):
        # Large star: every neighbour larger than the node is tied to the smallest neighbour.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: smaller neighbours and the node itself are tied to the smallest one.
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(floor.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        if rounds:
            continue
        seen = tuple(now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")),
                             F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first())
        if seen == mark or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
    if not rounds:
        raise RuntimeError("the components did not settle")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def slices(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to `most` at most, or single rows."""
    at, total = 0, 0
    for k, n in enumerate(sizes):
        if k > at and total + n > most:
            yield at, k
            at, total = k, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def hash_unit(*keys) -> Column:
    """Uniform in (0, 1), decided by the keys alone; in 52 bits of md5, so that SQL can repeat it."""
    from offertide.functions.draws import keyed_uniform

    seed, purpose, *rest = keys
    return keyed_uniform(seed, purpose, *rest)


__all__ = ["BROADCAST_ROWS", "NO_SPACES", "SPACES", "attach_groups", "connected", "hash_unit",
           "slices", "table", "text_or_empty", "written"]
