"""Exact quantiles at any size: a prefix sum over the counted distinct values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offertide.functions.ranked import PART, Ranked


def exact_quantiles(df: DataFrame, values: Mapping[str, str], at: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """(group..., name, q): per named SQL expression, the smallest values that reach each share of its rows.

    Nulls don't count. Equal values are merged in each task before they shuffle, and the
    distinct ones are laid out in ranges, so no column or group has to fit one task. Then only
    the pieces that hold a wanted rank are scanned.
    """
    listed = ", ".join(f"struct('{n}' AS name, CAST({sql} AS DOUBLE) AS value)" for n, sql in values.items())
    keys = [*group, "name"]
    counts = df.selectExpr(*group, f"inline(array({listed}))").where("value IS NOT NULL").groupBy(*keys, "value").agg(
        F.count(F.lit(1)).alias("n"))
    layout = Ranked(counts, [F.col("value")], keys, sized=True)
    # One row per piece and key: how many rows lie before and up to its end.
    piece = layout.rows.groupBy(*keys, PART).agg(F.sum("n").alias("own"))
    over = Window.partitionBy(*keys)
    upto = piece.select(*keys, PART, F.sum("own").over(over.orderBy(PART)).alias("upto"), F.sum("own").over(over).alias("total"), "own")
    shares = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * F.col("total")).alias("rank")) for i, q in enumerate(at)])
    wanted = upto.withColumn("want", F.explode(shares)).where(
        "greatest(want.rank, 1) <= upto AND greatest(want.rank, 1) > upto - own").select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col(PART).alias("_of_part"), "want.i", (F.col("want.rank") - F.col("upto") + F.col("own")).alias("rank"))
    # Only the pieces that hold a rank are scanned.
    holding = layout.rows.join(wanted, [*[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col(PART) == F.col("_of_part")])
    inside = Window.partitionBy(*keys, "i").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    reached = holding.withColumn("upto", F.sum("n").over(inside)).where("upto >= rank").groupBy(*keys).agg(
        *[F.min(F.when(F.col("i") == i, F.col("value"))).alias(f"q{i}") for i in range(len(at))])
    return reached.select(*keys, F.array(*[f"q{i}" for i in range(len(at))]).alias("q"))
