"""Uplift quadrants: who responds, who would buy anyway, who never buys, who is put off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offertide.operators.gain import CONVERSIONS, UNIT_PROFIT
from offertide.settings import GRAIN, Settings

PERSUADABLE, SURE_THING, LOST_CAUSE, SLEEPING_DOG = (
    "persuadable", "sure_thing", "lost_cause", "sleeping_dog")
QUADRANTS = (PERSUADABLE, SURE_THING, LOST_CAUSE, SLEEPING_DOG)


def add_quadrant(df: DataFrame, cfg: Settings, tau: str = "uplift", p: str = "p_convert") -> DataFrame:
    """Effect outside the dead band decides; inside it the conversion propensity does."""
    eps, cut = f"{cfg.quadrant_tau_epsilon!r}D", f"{cfg.quadrant_p_convert_threshold!r}D"
    return df.withColumn("quadrant", F.expr(
        f"CASE WHEN {tau} > {eps} THEN '{PERSUADABLE}' WHEN {tau} < -{eps} THEN '{SLEEPING_DOG}'"
        f" WHEN {p} >= {cut} THEN '{SURE_THING}' WHEN {p} < {cut} THEN '{LOST_CAUSE}' END"))


def quadrant_distribution(df: DataFrame) -> DataFrame:
    """Count and share per offer type and quadrant."""
    counted = df.groupBy("offer_type", "quadrant").agg(F.expr("count(1) AS n"))
    # A few rows per type remain.
    return counted.selectExpr("*", "n / sum(n) OVER (PARTITION BY offer_type) AS share")


def composition_at_budget(ranked: DataFrame, budget: int) -> DataFrame:
    """Quadrant mix of the top `budget` rows with their mean effect."""
    counted = ranked.where(F.col("rank") <= budget).groupBy("quadrant").agg(
        F.expr("count(1) AS n"), F.expr("avg(uplift) AS mean_tau"))
    return counted.selectExpr("quadrant", "n", "n / sum(n) OVER () AS share", "mean_tau")


def gain_by_quadrant(ranked: DataFrame, budget: int) -> DataFrame:
    """Incremental profit per quadrant inside the top `budget`; null where no control is left."""
    sums = ranked.where(F.col("rank") <= budget).groupBy("quadrant").agg(
        F.expr("count(1) AS n"), F.expr("count_if(treatment = 1) AS nt"), F.expr("count_if(treatment <> 1) AS nc"),
        F.expr("count_if(treatment = 1 AND converted = 1) AS ct"),
        F.expr("count_if(treatment <> 1 AND converted = 1) AS cc"),
        F.expr("sum(IF(treatment = 1 AND converted = 1, net_profit, 0D)) AS pt"),
        F.expr("avg(uplift) AS mean_tau"))
    return sums.selectExpr(
        "quadrant", "n", f"CASE WHEN nc > 0 THEN {CONVERSIONS} * {UNIT_PROFIT} END AS gain",
        "nc > 0 AS evaluable", "mean_tau")


def left_on_table(reference: DataFrame, chosen: DataFrame, budget: int) -> DataFrame:
    """Persuadables the reference ranking would pick that the chosen one leaves out."""
    picked = reference.where((F.col("rank") <= budget) & (F.col("quadrant") == PERSUADABLE)).select(*GRAIN)
    taken = chosen.where(F.col("rank") <= budget).select(*GRAIN, F.lit(1).alias("taken"))
    return (
        picked.join(taken, list(GRAIN), "left")
        .agg(F.expr("count(1) AS persuadables"), F.expr("count_if(taken IS NULL) AS missed"))
        .selectExpr("*", "try_divide(missed, persuadables) AS missed_share")
    )
