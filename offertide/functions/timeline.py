"""Running aggregates along the time line of each key.

As-of joins, interval ownership and "how many are open now" all become one
sorted pass over a union of events and probes, so the work is linear in the
rows: no key ever forms event x event pairs. A key that holds too many rows is
cut at quantiles of its own time line; each piece is scanned on its own and the
totals of the earlier pieces are added afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offertide.functions.storage import written

_SEGMENT = "_segment"
_CUTS = "_cuts"
_BROADCAST_KEYS = 10_000
SPREAD = 64
"""Places over which the rows of a hot key are dealt in joins."""


@dataclass(frozen=True)
class Run:
    """One running aggregate of a SQL expression: sum, count, min, max or moments (n, s, m2)."""

    name: str
    kind: str
    value: str

    def sql(self, over: str = "") -> str:
        v = self.value
        if self.kind != "moments":
            return f"{self.kind}({v}){over} AS {self.name}"
        n = f"count({v}){over}"
        return (
            f"named_struct('n', {n}, 's', coalesce(sum({v}){over}, 0D), "
            f"'m2', coalesce(var_pop({v}){over} * {n}, 0D)) AS {self.name}"
        )


@dataclass(frozen=True)
class HotKeys:
    """Keys too large for one task, with the times at which they are cut."""

    key: str
    table: DataFrame
    few: bool = True
    """Whether the table is small enough to be sent to every executor; else it is joined by shuffle."""

    def matched(self, rows: DataFrame, marks: DataFrame) -> DataFrame:
        """`rows` with the columns of `marks`, a part of the table, where their key is hot.

        Marks are broadcast while they are few. Beyond that they are repeated SPREAD times and the
        rows dealt by a hash of the whole row, so a hot key doesn't meet in one task.
        """
        key = marks.columns[0]
        if self.few:
            return rows.join(F.broadcast(marks), key, "left")
        dealt = rows.withColumn("_dealt", spread(rows.columns))
        every = marks.withColumn("_dealt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        return dealt.join(every, [key, "_dealt"], "left").drop("_dealt")

    def tag(self, rows: DataFrame, at: str) -> DataFrame:
        cuts = F.col(_CUTS)
        segment = F.size(F.filter(cuts, lambda c: c < F.col(at)))
        return (
            self.matched(rows, self.table)
            .withColumn(_SEGMENT, F.coalesce(F.when(cuts.isNotNull(), segment), F.lit(-1)))
            .drop(_CUTS)
        )


def spread(columns: Sequence[str]) -> Column:
    """One of SPREAD places for a row, by all its values."""
    return F.pmod(F.xxhash64(*columns), F.lit(SPREAD)).cast("int")


def find_hot_keys(rows: DataFrame, key: str, at: str, rows_per_task: int) -> HotKeys | None:
    """The keys with more than `rows_per_task` rows, or None when there is none.

    Every such key is cut, each by its own number of rows, in doubling classes of size.
    """
    spark = rows.sparkSession
    # The class doubles with the rows, so there are fewer than 64.
    hot = written(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where(
        F.col("_rows") > rows_per_task).selectExpr(key, f"CAST(ceil(log2(_rows / {rows_per_task})) AS INT) + 1 AS _class"), "hot-keys")
    classes = [r[0] for r in hot.select("_class").distinct().collect()]
    if not classes:
        return None
    few = hot.limit(_BROADCAST_KEYS + 1).count() <= _BROADCAST_KEYS
    marked = HotKeys(key, hot, few).matched(rows.select(key, at), hot.select(key, "_class"))
    cuts = None
    for c in classes:
        steps = [i / 2**c for i in range(1, 2**c)]
        part = marked.where(F.col("_class") == c).groupBy(key).agg(
            F.array_distinct(F.percentile_approx(at, steps, 10_000)).alias(_CUTS))
        cuts = part if cuts is None else cuts.unionByName(part)
    return HotKeys(key, written(cuts, "hot-cuts"), few)


def scan(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    runs: Sequence[Run],
    hot: HotKeys | None = None,
    at: str = "at",
    descending: bool = False,
) -> DataFrame:
    """`rows` plus one column per run, aggregated up to and including the row.

    `order` is a SQL sort list that begins with `at`, in the direction given by
    `descending`.
    """
    if hot is None:
        over = _over(keys, order)
        return rows.selectExpr("*", *[r.sql(over) for r in runs])

    tagged = hot.tag(rows, at)
    inside = tagged.selectExpr("*", *[r.sql(_over([*keys, _SEGMENT], order)) for r in runs])

    # One row per piece of a hot key, joined by the partitioning that the scan already has.
    totals = (
        tagged.where(f"{_SEGMENT} >= 0").groupBy(*keys, _SEGMENT)
        .agg(*[F.expr(r.sql()) for r in runs])
    )
    by_piece = F.desc(_SEGMENT) if descending else F.asc(_SEGMENT)
    before = (
        Window.partitionBy(*keys).orderBy(by_piece).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.select(
        *keys, _SEGMENT, *[_carry(r, before).alias(_before(r)) for r in runs]
    )
    for k in (*keys, _SEGMENT):
        carried = carried.withColumnRenamed(k, f"_of_{k}")
    first, *others = keys
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in others]  # null offers are scanned together
    joined = inside.join(carried, [F.col(first) == F.col(f"_of_{first}"), F.col(_SEGMENT) == F.col(f"_of_{_SEGMENT}"), *same], "left")
    kept = [c for c in inside.columns if c != _SEGMENT and c not in {r.name for r in runs}]
    return joined.select(*kept, *[_merge(r).alias(r.name) for r in runs])


def _over(keys: Sequence[str], order: str) -> str:
    return (
        f" OVER (PARTITION BY {', '.join(keys)} ORDER BY {order}"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )


def _before(run: Run) -> str:
    return f"_before_{run.name}"


def _carry(run: Run, window) -> Column:
    value = F.col(run.name)
    if run.kind == "moments":
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("m2"))
        return F.aggregate(F.collect_list(value).over(window), zero, _pooled)
    return {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}[run.kind](value).over(window)


def _merge(run: Run) -> Column:
    here, before = F.col(run.name), F.col(_before(run))
    if run.kind == "moments":
        return F.when(before.isNull(), here).otherwise(_pooled(before, here))
    if run.kind == "count":
        return F.coalesce(before, F.lit(0)) + here
    if run.kind == "sum":
        return F.when(before.isNull(), here).otherwise(before + F.coalesce(here, before * 0))
    return F.least(before, here) if run.kind == "min" else F.greatest(before, here)


def _pooled(a: Column, b: Column) -> Column:
    """Count, sum and squared deviations of two samples put together."""
    n = a["n"] + b["n"]
    gap = F.try_divide(b["s"], b["n"]) - F.try_divide(a["s"], a["n"])
    between = F.coalesce(gap * gap * F.try_divide(a["n"] * b["n"], n), F.lit(0.0))
    return F.struct(
        n.alias("n"), (a["s"] + b["s"]).alias("s"), (a["m2"] + b["m2"] + between).alias("m2")
    )
