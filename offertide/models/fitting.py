"""Running independent model fits side by side, on rows laid out for many small passes."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offertide.functions.storage import written

T = TypeVar("T")


def together(fits: Mapping[Hashable, Callable[[], T]], threads: int) -> dict[Hashable, T]:
    """Results of independent fits, at most `threads` of them at a time; the first failure is raised.

    A boosted fit is a long chain of short jobs that leaves most of a cluster idle, so
    chains of several fits fill it without more memory than their own cached rows.
    """
    if not fits:
        return {}
    with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
        session = SparkSession.active()
        # One wrapper each: a wrapper hands the same local properties to all it wraps, and Spark changes them in place.
        running = {name: pool.submit(inheritable_thread_target(session)(fit)) for name, fit in fits.items()}
        return {name: future.result() for name, future in running.items()}


def for_trees(rows: DataFrame, min_rows: int) -> DataFrame:
    """`rows` whose categories are plain numbers if there are too few rows for Spark to bin them.

    Fewer than two leaves' rows can't be split at all, so up to there the fit is the same constant.
    """
    few = max(2 * min_rows, 8)
    if rows.limit(few).count() < few:
        plain = F.col("features").alias("features", metadata={"plain": True})
        return rows.select(*[plain if c == "features" else F.col(c) for c in rows.columns])
    return rows


FEW = 25_000
"""Rows that are not worth a task of their own in a pass: they are binned and summed in some milliseconds."""
LONG = 10
"""One wave of long tasks is faster than several of short ones, so tasks grow this much before there are more than cores."""


def part_sizes(stored: DataFrame, *group: str) -> dict[tuple, list[int]]:
    """Rows of each partition that holds any, per value of the few-valued `group`."""
    found = stored.groupBy(*group, F.spark_partition_id()).count().collect()  # at most a row per partition and value
    sizes: dict[tuple, list[int]] = {}
    for r in found:
        sizes.setdefault(tuple(r[g] for g in group), []).append(r["count"])
    return sizes


def laid_out(df: DataFrame, rows_per_task: int, name: str = "fit-rows") -> DataFrame:
    """`df` stored once and dealt evenly for many passes."""
    stored = written(df, name)
    return dealt(stored, part_sizes(stored).get((), []), rows_per_task)


def dealt(stored: DataFrame, sizes: Sequence[int], rows_per_task: int, beside: int | None = None) -> DataFrame:
    """`stored`, whose partitions have `sizes` rows, in as many equal ones as its share of the cores can take.

    Each pass of a fit runs one task per partition and waits for the longest. So small data should not be in
    many, and larger data in equal tasks on all cores, whatever files it was stored in. `beside` counts
    the rows of all fits that run at the same time, which share the cores.
    """
    cores, count = stored.sparkSession.sparkContext.defaultParallelism, sum(sizes)
    share = max(1, min(round(cores * count / max(beside or count, 1)), count // FEW))
    parts = share * max(1, -(-count // (LONG * rows_per_task * share)))
    if parts == 1:
        return stored.coalesce(1)
    even = parts <= len(sizes) <= 1.5 * parts and max(sizes) * len(sizes) <= 1.25 * count
    return stored if even else stored.repartition(parts)
