"""Qini and uplift areas of a ranking, and the placebo test.

Definitions (Radcliffe 2007): sort by score descending and keep the last row of each
tied score. Qini curve: yt - yc * nt / nc; uplift curve: (yt / nt - yc / nc) * n, with
0 for a ratio whose count is 0. Both start at the origin. The coefficient is the area
above the straight line to the last point, relative to the same area of the perfect
order. Perfect orders: y*t - y*(1-t) for Qini; 2*[y = t] + s for the uplift curve, with
s = y when converted controls outnumber unconverted treated rows, else s = t.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offertide.functions.draws import keyed_uniform
from offertide.functions.ranked import Ranked, numbered
from offertide.operators.ranking import by_strategy
from offertide.settings import GRAIN, Settings

_COUNTS = {
    "n": "1L",
    "nt": "IF(treatment = 1, 1L, 0L)",
    "yt": "IF(treatment = 1, CAST(converted AS BIGINT), 0L)",
    "yc": "IF(treatment = 1, 0L, CAST(converted AS BIGINT))",
}


def _qini(p: str = "") -> str:
    nt, nc = f"({p}nt)", f"({p}n - {p}nt)"
    return f"({p}yt - IF({nc} > 0, {p}yc * ({nt} / {nc}), 0D))"


def _uplift(p: str = "") -> str:
    nt, nc = f"({p}nt)", f"({p}n - {p}nt)"
    return f"((IF({nt} > 0, {p}yt / {nt}, 0D) - IF({nc} > 0, {p}yc / {nc}, 0D)) * ({p}n))"


def _tied(df: DataFrame, scores: Mapping[str, str]) -> DataFrame:
    """One row per strategy and distinct score, summed before the shuffle."""
    return by_strategy(df, scores, ("treatment", "converted")).groupBy("strategy", "score").agg(
        *[F.expr(f"sum({sql}) AS own_{c}") for c, sql in _COUNTS.items()])


def _points(df: DataFrame, scores: Mapping[str, str]) -> DataFrame:
    ranked = Ranked(_tied(df, scores), [F.desc("score")], ["strategy"], sized=True)
    return ranked.running(ranked.rows, sums={c: F.col(f"own_{c}") for c in _COUNTS})


def _with_areas(points: DataFrame, group: list[str]) -> DataFrame:
    previous = points.selectExpr("*", *[f"{c} - own_{c} AS b_{c}" for c in _COUNTS])
    return (
        previous.selectExpr(
            *group, "n", f"{_qini()} AS qini_here", f"{_uplift()} AS uplift_here",
            f"own_n * ({_qini()} + {_qini('b_')}) / 2 AS qini_part",
            f"own_n * ({_uplift()} + {_uplift('b_')}) / 2 AS uplift_part")
        .groupBy(*group)
        .agg(F.expr("sum(qini_part) AS qini_area"), F.expr("sum(uplift_part) AS uplift_area"),
             F.expr("max(n) AS rows"), F.expr("max_by(qini_here, n) AS qini_end"),
             F.expr("max_by(uplift_here, n) AS uplift_end"))
    )


def _perfect(df: DataFrame) -> DataFrame:
    """Areas of the two perfect orders: one row, from at most four (outcome, arm) groups."""
    cells = df.groupBy("converted", "treatment").agg(
        *[F.expr(f"sum({sql}) AS own_{c}") for c, sql in _COUNTS.items()])
    lean = cells.agg(F.expr(
        "coalesce(sum(IF(converted = 1 AND treatment = 0, own_n, 0L)), 0L)"
        " > coalesce(sum(IF(converted = 0 AND treatment = 1, own_n, 0L)), 0L) AS by_outcome"))
    scored = cells.crossJoin(lean).selectExpr(
        "*", "inline(array(struct('qini' AS curve, converted * treatment - converted * (1 - treatment) AS score),"
        " struct('uplift' AS curve, 2 * IF(converted = treatment, 1, 0) + IF(by_outcome, converted, treatment) AS score)))")
    tied = scored.groupBy("curve", "score").agg(*[F.expr(f"sum(own_{c}) AS own_{c}") for c in _COUNTS])
    order = Window.partitionBy("curve").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    points = tied.select("*", *[F.sum(f"own_{c}").over(order).alias(c) for c in _COUNTS])
    return _with_areas(points, ["curve"]).agg(
        F.expr("max(CASE WHEN curve = 'qini' THEN qini_area END) AS best_qini"),
        F.expr("max(CASE WHEN curve = 'uplift' THEN uplift_area END) AS best_uplift"))


def qini_auuc(df: DataFrame, scores: Mapping[str, str]) -> DataFrame:
    """(strategy, qini, auuc) for rows with `treatment`, `converted` and each score."""
    areas = _with_areas(_points(df, scores), ["strategy"])
    return areas.crossJoin(_perfect(df)).selectExpr(
        "strategy",
        "try_divide(qini_area - rows * qini_end / 2, best_qini - rows * qini_end / 2) AS qini",
        "try_divide(uplift_area - rows * uplift_end / 2, best_uplift - rows * uplift_end / 2) AS auuc")


def qini_curves(df: DataFrame, scores: Mapping[str, str]) -> DataFrame:
    """(strategy, n_targeted, gain) at every distinct score, from the origin."""
    points = _points(df, scores).selectExpr("strategy", "n AS n_targeted", f"{_qini()} AS gain")
    names = ", ".join(f"'{s}'" for s in scores)
    origin = df.limit(1).selectExpr(f"explode(array({names})) AS strategy", "0L AS n_targeted", "0D AS gain")
    return points.unionByName(origin)


def metrics_table(df: DataFrame, scores: Mapping[str, str]) -> DataFrame:
    """Long metrics: (strategy, metric, value)."""
    return qini_auuc(df, scores).selectExpr(
        "strategy", "inline(array(struct('qini' AS metric, qini AS value), struct('auuc' AS metric, auuc AS value)))")


def treatment_slots(df: DataFrame) -> DataFrame:
    """Rows with their place in key order inside each offer type, which every shuffle shares."""
    return numbered(df.drop("treatment"), [F.asc(k) for k in GRAIN], ["offer_type"], "slot", sized=True)


def shuffle_treatment(df: DataFrame, seed: int, replicate: int = 0, slots: DataFrame | None = None) -> DataFrame:
    """Treatment permuted inside each offer type; the size of each arm is kept.

    The k-th row in key order takes the treatment of the k-th row in hash order. Both
    positions come from range layouts, so a type may hold any share of the rows. `slots`
    are those of `df`, if they are at hand.
    """
    slots = treatment_slots(df) if slots is None else slots
    hashed = df.select("offer_type", "treatment", *GRAIN,
                       keyed_uniform(seed, "placebo", F.lit(replicate), *GRAIN).alias("u"))
    dealt = numbered(hashed, [F.asc("u"), *[F.asc(k) for k in GRAIN]], ["offer_type"], "slot", sized=True).select("offer_type", "slot", "treatment")
    return slots.join(dealt, ["offer_type", "slot"]).select(*df.columns)


def placebo_verdict(score: float, null: DataFrame, cfg: Settings) -> DataFrame:
    """Real score against the null scores (column `qini`): threshold, p value, spread."""
    level, real = cfg.placebo_confidence_level, f"{float(score)!r}D"
    return null.agg(
        F.expr(f"percentile(qini, {level!r}) AS threshold"),
        F.expr(f"count_if(qini >= {real}) / count(1) AS p_value"),
        F.expr("avg(qini) AS null_mean"), F.expr("stddev_pop(qini) AS null_std"),
    ).selectExpr(f"{real} AS qini_real", "threshold", f"{real} > threshold AS passed",
                 "p_value", "null_mean", "null_std")
