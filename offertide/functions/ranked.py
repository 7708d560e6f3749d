"""Prefix sums over a total order that is too long for one task.

The rows are range-partitioned by the order and stored once, so that every
later pass sees the same partitions. Each partition is scanned on its own; one
total per partition, summed over the earlier partitions, is then added.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from offertide.functions.storage import discard, written

PART = "_part"


PIECE_ROWS = 1_000_000
"""Rows of a piece of a layout that is sized by its rows."""
_SMALL_PIECE = 20_000


class Ranked:
    """Rows in a stored range layout, one independent order per group.

    With `sized` the input is stored first, so that it is computed once and its rows decide the
    number of pieces; else it is `partitions` or the session's number of shuffle partitions.
    `piece` numbers the pieces of each group in the order, if the place of a row is known: then nothing is dealt out.
    """

    def __init__(self, df: DataFrame, order: Sequence[Column], group: Sequence[str] = (),
                 partitions: int | None = None, sized: bool = False, piece_rows: int = PIECE_ROWS,
                 piece: Column | None = None) -> None:
        self.group = list(group)
        self.order = list(order)
        if piece is not None:
            self.rows = written(df.withColumn(PART, piece), "layout")
            return
        spark = df.sparkSession
        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if sized and not partitions:
            df = written(df, "unordered")
            count = df.count()
            # As many pieces as the session has, but none smaller than is worth a task or larger than a piece.
            n = max(1, min(n, -(-count // min(_SMALL_PIECE, piece_rows))), -(-count // piece_rows))
        laid = df.repartitionByRange(n, *[F.col(g) for g in self.group], *self.order)
        self.rows = written(laid.withColumn(PART, F.spark_partition_id()), "layout")
        if sized and not partitions:
            discard(df)

    def _inside(self) -> WindowSpec:
        return (
            Window.partitionBy(*self.group, PART).orderBy(*self.order)
            .rowsBetween(Window.unboundedPreceding, 0)
        )

    def _with_earlier(self, local: DataFrame, totals: DataFrame, pieces: Sequence[tuple]) -> DataFrame:
        """`local` running values, raised by the totals of earlier pieces of their group."""
        earlier = (
            Window.partitionBy(*self.group).orderBy(PART)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        before = totals.select(
            *self.group, PART, *[fn(n).over(earlier).alias(f"_before_{n}") for n, fn, _ in pieces]
        )
        for c in (*self.group, PART):
            before = before.withColumnRenamed(c, f"_of_{c}")
        same = [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in self.group]  # a null group is a group too
        joined = local.join(before, [*same, F.col(PART) == F.col(f"_of_{PART}")], "left")
        kept = [c for c in local.columns if c not in {n for n, _, _ in pieces}]
        out = []
        for n, fn, _ in pieces:
            prior = F.col(f"_before_{n}")
            both = prior + F.col(n) if fn is F.sum else F.greatest(prior, F.col(n))
            out.append(F.when(prior.isNull(), F.col(n)).otherwise(both).alias(n))
        return joined.select(*kept, *out)

    def running(self, rows: DataFrame, sums: Mapping[str, Column] | None = None,
                maxima: Mapping[str, Column] | None = None) -> DataFrame:
        """`rows` (the layout, possibly with more columns) plus running sums and maxima."""
        pieces = [(n, F.sum, c) for n, c in (sums or {}).items()]
        pieces += [(n, F.max, c) for n, c in (maxima or {}).items()]
        local = rows.select("*", *[fn(c).over(self._inside()).alias(n) for n, fn, c in pieces])
        # At most one row per partition and group.
        totals = rows.groupBy(*self.group, PART).agg(*[fn(c).alias(n) for n, fn, c in pieces])
        return self._with_earlier(local, totals, pieces)

    def running_maxima(self, sums: Mapping[str, Column], maxima: Mapping[str, Column], keep: Sequence[str],
                       wanted: Column | None = None) -> DataFrame:
        """Columns `keep` and running maxima of expressions over running sums, of the rows that are `wanted`.

        Sums and maxima are scanned in one pass over the layout, which is stored; what the maxima
        of earlier pieces add is then a join with one row per piece.
        """
        pieces = [(n, F.max, c) for n, c in maxima.items()]
        summed = self.running(self.rows, sums)
        over = self._inside()
        local = summed.select(*self.order_columns(), *self.group, PART, *keep, *[c.alias(f"_own_{n}") for n, c in maxima.items()])
        running = [F.max(f"_own_{n}").over(over).alias(n) for n in maxima]
        if wanted is None:
            local = written(local.select(*self.group, PART, *keep, *running), "curve")
        else:  # and the last row of each piece, which holds its total
            last = F.lead(F.lit(True)).over(Window.partitionBy(*self.group, PART).orderBy(*self.order)).isNull()
            local = written(local.select(*self.group, PART, *keep, *running, last.alias("_last"))
                            .where(wanted | F.col("_last")).drop("_last"), "curve")
        totals = local.groupBy(*self.group, PART).agg(*[F.max(n).alias(n) for n in maxima])
        found = self._with_earlier(local, totals, pieces)
        return found if wanted is None else found.where(wanted)

    def order_columns(self) -> list[str]:
        """Columns of the layout that the order may refer to."""
        return [c for c in self.rows.columns if c not in (*self.group, PART)]


def numbered(df: DataFrame, order: Sequence[Column], group: Sequence[str] = (),
             name: str = "rank", partitions: int | None = None, sized: bool = False) -> DataFrame:
    """1-based position in a total order, without a single-task window."""
    ranked = Ranked(df, order, group, partitions, sized)
    out = ranked.running(ranked.rows, sums={name: F.lit(1).cast("long")})
    return out.drop(PART)


SMALL_TOP = 10_000


def top(df: DataFrame, order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first `n` rows of a total order with their position.

    A short list is merged from per-task heaps, without sorting the table; a long one
    is cut from the full numbering, so that it never passes through one task.
    """
    if n <= SMALL_TOP:
        head = df.orderBy(*order).limit(n)
        return head.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    return numbered(df, order, name=name).where(F.col(name) <= n)
