"""Joins on a key that a few values may dominate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offertide.functions.timeline import SPREAD, HotKeys, spread


def keyed_join(rows: DataFrame, side: DataFrame, key: str, hot: HotKeys | None, how: str = "left") -> DataFrame:
    """`rows` joined with the few rows that `side` has for each key; how is left or inner.

    The rows of a hot key are dealt to SPREAD places by a hash of the whole row, and its
    side rows are repeated there, so no task holds more than a share of a key.
    """
    if hot is None:
        return rows.join(side, key, how)
    mark = F.lit(True).alias("_hot")
    marks = hot.table.select(hot.key, mark).withColumnRenamed(hot.key, key)
    place = F.coalesce(F.when(F.col("_hot"), spread(rows.columns)), F.lit(0))
    left = hot.matched(rows, marks).withColumn("_place", place).drop("_hot")
    places = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    right = hot.matched(side, marks).withColumn("_place", F.explode(places)).drop("_hot")
    return left.join(right, [key, "_place"], how).drop("_place")
