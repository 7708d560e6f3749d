"""Incremental gain of the top-N of a ranking, with bands and decile views.

At prefix N: `ct`, `cc` converted treated and control, `nt`, `nc` rows per arm, `pt`
profit of converted treated rows. Incremental conversions are ct - cc * nt / nc (ct
while there is no control), gain is conversions times pt / ct, and both are reported
as the running maximum from 0.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offertide.arrays.bands import MEASURES, Shape, bands, drawn, packed, peaks
from offertide.functions.draws import keyed_uniform
from offertide.functions.ranked import PIECE_ROWS, Ranked
from offertide.functions.storage import written
from offertide.operators.ranking import best_first, by_strategy
from offertide.settings import Settings

_INPUTS = ("treatment", "converted", "net_profit")
_SUMS = {
    "n": "1L",
    "nt": "IF(treatment = 1, 1L, 0L)",
    "nc": "IF(treatment = 1, 0L, 1L)",
    "ct": "IF(treatment = 1, CAST(converted AS BIGINT), 0L)",
    "cc": "IF(treatment = 1, 0L, CAST(converted AS BIGINT))",
    "pt": "IF(treatment = 1 AND converted = 1, net_profit, 0D)",
}
_BANDS = "strategy string, n long, gain_lo double, gain_hi double, conversions_lo double, conversions_hi double"
BLOCK, STRETCH, DRAWS_PER_TASK = 4_096, 16_384, 500_000
"""Places of a block of resamples, points of a stretch of bands and draws of a task: some tens of MB each."""
MOST_PARTS = 1_000
CONVERSIONS = "(ct - IF(nc > 0, cc * (nt / nc), 0D))"
UNIT_PROFIT = "IF(ct > 0, pt / ct, 0D)"


def gain_curves(df: DataFrame, scores: Mapping[str, str]) -> DataFrame:
    """(strategy, n, gain, conversions) for n = 0 .. rows, one curve per strategy."""
    return _curves(by_strategy(df, scores, _INPUTS), ["strategy"], best_first())


def gain_curve(df: DataFrame, score: str) -> DataFrame:
    """The curve of one score."""
    return gain_curves(df, {"one": score}).drop("strategy")


def _curves(rows: DataFrame, group: list[str], order: list, piece: Column | None = None,
            points: Sequence[int] | None = None) -> DataFrame:
    """Curves of each group, or only their rows at the given points and the origin."""
    ranked = Ranked(rows, order, group, sized=True, piece=piece)
    wanted = None if points is None else F.col("n").isin([int(p) for p in points])
    maxima = {"gain": F.expr(f"{CONVERSIONS} * {UNIT_PROFIT}"), "conversions": F.expr(CONVERSIONS)}
    top = ranked.running_maxima({n: F.expr(sql) for n, sql in _SUMS.items()}, maxima, ["n"], wanted)
    curve = top.selectExpr(*group, "n", "greatest(gain, 0D) AS gain", "greatest(conversions, 0D) AS conversions")
    origin = ranked.rows.select(*group).distinct().selectExpr(*group, "0L AS n", "0D AS gain", "0D AS conversions")
    return curve.unionByName(origin)


def at_budgets(curves: DataFrame, budgets: Sequence[int]) -> DataFrame:
    """Per strategy and budget, the curve point with the largest n not above the budget."""
    values = [c for c in curves.columns if c != "strategy"]
    listed = ", ".join(f"{int(b)}L" for b in budgets)
    return (
        curves.selectExpr("*", f"explode(array({listed})) AS budget").where("n <= budget")
        .groupBy("strategy", "budget")
        .agg(F.max_by(F.struct(*values), "n").alias("point"))
        .select("strategy", "budget", "point.*")
    )


def _decile_points(curves: DataFrame, group: list[str]) -> DataFrame:
    """Curve rows at round-half-even(rows * d / 10), d = 0 .. 10."""
    ends = curves.groupBy(*group).agg(F.max("n").alias("rows"))
    cuts = ends.selectExpr(*group, "rows", "explode(sequence(0, 10)) AS decile").selectExpr(
        *group, "decile", "CAST(bround(rows * decile / 10) AS BIGINT) AS n")
    return curves.join(cuts, [*group, "n"])


def conversions_by_decile(df: DataFrame, scores: Mapping[str, str]) -> DataFrame:
    """Marginal incremental conversions of each tenth of a ranking."""
    return _marginals(gain_curves(df, scores), ["strategy"])


def _marginals(curves: DataFrame, group: list[str]) -> DataFrame:
    # Eleven rows per group.
    step = Window.partitionBy(*group).orderBy("decile")
    return (
        _decile_points(curves, group)
        .withColumn("conversions", F.col("conversions") - F.lag("conversions").over(step))
        .where("decile > 0").select(*group, "decile", "conversions")
    )


def best_lambda_by_decile(df: DataFrame, grid: Sequence[float]) -> DataFrame:
    """Per budget decile the fixed blend weight with the largest gain (first one on ties)."""
    long = df.selectExpr("*", "explode(array({})) AS lambda".format(
        ", ".join(f"{float(v)!r}D" for v in grid)))
    rows = long.selectExpr("account_id", "offer_id", "received_time", *_INPUTS, "lambda",
                           "uplift + lambda * p_convert AS score")
    curves = _curves(rows, ["lambda"], best_first())
    place = "array_position(array({}), lambda)".format(", ".join(f"{float(v)!r}D" for v in grid))
    return (
        _decile_points(curves, ["lambda"]).where("decile > 0").groupBy("decile")
        .agg(F.expr(f"max(struct(gain, -{place} AS earlier, lambda)) AS best"))
        .selectExpr("decile", "best.lambda AS best_lambda", "best.gain AS gain")
    )


def _resampled_curves(df: DataFrame, scores: Mapping[str, str], cfg: Settings, replicates: int,
                      points: Callable[[int], Sequence[int] | None]) -> DataFrame:
    """Curves of bootstrap resamples that keep the ranking order.

    Every replicate draws as many positions as there are rows, by keyed hash; the
    same draws serve all strategies. Places are drawn evenly, so equal ranges of them are
    pieces of a replicate, which may be larger than a task. `points` gives the wanted points for the number of rows.
    """
    spark = df.sparkSession
    ranked = Ranked(by_strategy(df, scores, _INPUTS), best_first(), ["strategy"], sized=True)
    placed = ranked.running(ranked.rows, sums={"place": F.lit(1).cast("long")})
    n = df.count()
    drawn = (
        spark.range(n * replicates)
        .selectExpr(f"CAST(id DIV {n} AS INT) + 1 AS replicate", f"id % {n} AS draw")
        .withColumn("u", keyed_uniform(cfg.seed, "resample", "replicate", "draw"))
        .selectExpr("replicate", f"CAST(floor(u * {n}) AS BIGINT) + 1 AS place")
        .groupBy("replicate", "place").agg(F.expr("CAST(count(1) AS INT) AS copies"))
    )
    rows = placed.select("strategy", "place", *_INPUTS).join(drawn, "place").selectExpr(
        "strategy", "replicate", "place", *_INPUTS, "explode(sequence(1, copies)) AS copy")
    pieces = max(1, -(-n // PIECE_ROWS))
    return _curves(rows, ["strategy", "replicate"], [F.asc("place"), F.asc("copy")],
                   F.expr(f"CAST((place - 1) * {pieces}L DIV {max(n, 1)}L AS INT)"), points(n))


def _bands_everywhere(df: DataFrame, scores: Mapping[str, str], cfg: Settings, replicates: int,
                      tails: tuple[float, float]) -> DataFrame:
    """(strategy, n, bands) at every n, of the resamples of `_resampled_curves`.

    No row is made per replicate and point: a block of places holds how often each replicate drew each of them, and the
    curves of all replicates are followed block by block, from the sums and maxima of the blocks before.
    """
    spark, n = df.sparkSession, df.count()
    shape = Shape(tuple(scores), replicates, n, BLOCK, STRETCH, cfg.seed, DRAWS_PER_TASK, tails)
    origin = spark.createDataFrame([(s, 0, 0.0, 0.0, 0.0, 0.0) for s in scores if n], _BANDS)
    if not n:
        return origin
    ranked = Ranked(by_strategy(df, scores, _INPUTS), best_first(), ["strategy"], sized=True)
    placed = ranked.running(ranked.rows, sums={"place": F.lit(1).cast("long")}).selectExpr(
        f"(place - 1) DIV {BLOCK} AS block", "strategy", "place", *[f"coalesce(CAST({_SUMS[m]} AS DOUBLE), 0D) AS {m}" for m in MEASURES])
    tasks = -(-n * replicates // DRAWS_PER_TASK)
    draws = spark.range(0, tasks, 1, tasks).mapInArrow(drawn(shape), "block long, codes binary")
    # A fixed number of tasks, as their work doesn't follow from their bytes.
    def by(table: DataFrame, key: str):
        return table.repartition(min(-(-n // (BLOCK if key == "block" else STRETCH)), MOST_PARTS), key).groupBy(key)

    def earlier(table: DataFrame, column: str, fold: Callable) -> DataFrame:
        before = Window.partitionBy("pos").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        return table.selectExpr("block", f"posexplode({column}) AS (pos, value)").select("block", "pos", fold("value").over(before).alias("before"))

    blocks = written(by(draws, "block").cogroup(by(placed, "block")).applyInArrow(
        packed(shape), "block long, counts binary, rows binary, sums array<double>"), "resampled-blocks")
    sums = written(earlier(blocks, "sums", F.sum), "resampled-sums")
    tops = written(by(blocks, "block").cogroup(by(sums, "block")).applyInArrow(
        peaks(shape), "block long, peaks array<double>, stretches array<long>"), "resampled-peaks")
    places = tops.selectExpr("block", "explode(stretches) AS stretch")
    starts = sums.selectExpr("block", "false AS is_peak", "pos", "before").unionByName(
        earlier(tops, "peaks", F.max).selectExpr("block", "true AS is_peak", "pos", "before"))
    found = by(blocks.select("block", "counts", "rows").join(places, "block"), "stretch").cogroup(
        by(starts.join(places.withColumnRenamed("stretch", "near"), "block"), "near")).applyInArrow(bands(shape), _BANDS)
    return found.unionByName(origin)


def gain_curves_with_bands(df: DataFrame, scores: Mapping[str, str], cfg: Settings,
                           replicates: int | None = None, points: Sequence[int] | None = None) -> DataFrame:
    """Curves with percentile bootstrap bands at every n, or only at the given points."""
    tail = (1 - cfg.gain_curve_confidence_level) / 2
    replicates = replicates or cfg.gain_curve_n_bootstrap
    curves = gain_curves(df, scores)
    if points is None:
        return curves.join(_bands_everywhere(df, scores, cfg, replicates, (tail, 1 - tail)), ["strategy", "n"])
    wanted = F.col("n").isin([int(p) for p in points])
    resampled, curves = _resampled_curves(df, scores, cfg, replicates, lambda n: points).where(wanted), curves.where(wanted)
    bands = resampled.groupBy("strategy", "n").agg(*[
        F.expr(f"percentile({c}, {q!r}) AS {c}_{side}")
        for c in ("gain", "conversions") for side, q in (("lo", tail), ("hi", 1 - tail))])
    return curves.join(bands, ["strategy", "n"])


def conversions_by_decile_with_bands(df: DataFrame, scores: Mapping[str, str], cfg: Settings,
                                     replicates: int | None = None) -> DataFrame:
    tail = (1 - cfg.gain_curve_confidence_level) / 2
    # Every replicate has as many rows as the frame, so the ends of the deciles are known.
    resampled = _resampled_curves(df, scores, cfg, replicates or cfg.gain_curve_n_bootstrap,
                                  lambda n: [round(n * d / 10) for d in range(11)])
    bands = _marginals(resampled, ["strategy", "replicate"]).groupBy("strategy", "decile").agg(
        F.expr(f"percentile(conversions, {tail!r}) AS conversions_lo"),
        F.expr(f"percentile(conversions, {1 - tail!r}) AS conversions_hi"))
    return conversions_by_decile(df, scores).join(bands, ["strategy", "decile"])


