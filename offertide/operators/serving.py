"""Scoring frame, recommendation, allocation under filters and forward projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offertide.functions.draws import fnv_uniform
from offertide.functions.ranked import numbered, top
from offertide.functions.storage import small_or_same, spread, written
from offertide.functions.timeline import HotKeys
from offertide.operators import clean
from offertide.operators.contract import enforce_schema
from offertide.operators.features import ACTIVE, ALL_BLOCKS, history, offer_terms
from offertide.operators.gain import at_budgets, gain_curves
from offertide.operators.ranking import best_first, softmax_key
from offertide.settings import PAID_TYPES, Settings

RECOMMENDATION_COLUMNS = ("rank", "account_id", "offer_id", "offer_type", "score")
PAIR = ("account_id", "offer_id")
RANDOM, CONVERSION, UPLIFT = "random", "conversion", "uplift"
STRATEGY_COLUMNS = {RANDOM: "score_random", CONVERSION: "p_convert", UPLIFT: "score_dynamic"}


def decision_time(events: DataFrame, given: float | None = None) -> DataFrame:
    """One row: the given moment, or the last event."""
    if given is not None:
        return events.sparkSession.range(1).selectExpr(f"{float(given)!r}D AS decision_time")
    return events.agg(F.expr("max(time) AS decision_time"))


def scoring_grain(profile: DataFrame, active_offers: DataFrame, at: float) -> DataFrame:
    """Every customer with every active offer at one moment."""
    offers = active_offers.selectExpr("id AS offer_id")
    return profile.select("account_id").crossJoin(offers).selectExpr(
        "account_id", "offer_id", f"{float(at)!r}D AS received_time")


@dataclass(frozen=True)
class ScoringGrid:
    """Stored customers with their history and active offers with their terms, of which every pair is wanted.

    The grid itself is never stored: a reader pays for the columns and offers it takes.
    """

    customers: DataFrame
    offers: DataFrame
    small: bool
    """Whether the offers are a table of the driver's."""
    rows_per_task: int

    def where(self, condition: Column) -> "ScoringGrid":
        """The grid of only those offers."""
        return replace(self, offers=self.offers.where(condition))

    def dealt(self) -> DataFrame:
        """The customers, dealt to tasks by the pairs that are made from them."""
        return spread(self.customers, self.customers.count() * self.offers.count(), self.rows_per_task)

    def pairs(self) -> DataFrame:
        """Contract rows of every pair."""
        return enforce_schema(self.dealt().crossJoin(self.offers))


def scoring_grid(events: DataFrame, offers: DataFrame, profile: DataFrame, at: float, cfg: Settings,
                 active: DataFrame | None = None, receipts: DataFrame | None = None,
                 hot: HotKeys | None = None) -> ScoringGrid:
    """Every customer and active offer, with history up to `at`.

    History is computed and stored once per customer and only then combined with the offers.
    Concurrency counts the other offers of the grid, unless real `receipts` are given.
    """
    active = offers if active is None else active
    moments = profile.selectExpr("account_id", f"{float(at)!r}D AS received_time")
    blocks = ALL_BLOCKS if receipts is not None else tuple(b for b in ALL_BLOCKS if b != ACTIVE)
    past = history(moments, events, offers, blocks, receipts, hot)
    # All that depends on the offer alone is joined before the grid is formed.
    terms = offer_terms(active.selectExpr("id AS offer_id"), offers).selectExpr(
        "*", "1 AS treatment", "0 AS converted", "0D AS conversion_value", "0 AS is_recurrent",
        "0 AS campaign_wave")
    if receipts is None:
        others = active.agg(F.expr("CAST(count(duration) AS INT) AS n_known"))
        terms = terms.crossJoin(others).selectExpr(
            *terms.columns, "n_known - IF(duration IS NULL, 0, 1) AS n_concurrent_offers")
    priced, small = small_or_same(clean.add_reward_cost(terms, offers), cfg.small_table_rows)
    stored = written(profile.join(past, "account_id", "left"), "customers")
    return ScoringGrid(stored, priced, small, cfg.grid_rows_per_task)


def build_scoring_frame(events: DataFrame, offers: DataFrame, profile: DataFrame, at: float, cfg: Settings,
                        active: DataFrame | None = None, receipts: DataFrame | None = None,
                        hot: HotKeys | None = None) -> DataFrame:
    """Contract rows for every (customer, active offer), with history up to `at`."""
    return scoring_grid(events, offers, profile, at, cfg, active, receipts, hot).pairs()


def best_offer_per_customer(scored: DataFrame, score: str = "score", group: Sequence[str] = (),
                            keep: Sequence[str] = ()) -> DataFrame:
    """Highest score per customer, smaller offer id on ties; null scores never win.

    An aggregation with partial maxima, so a customer with very many rows costs no more.
    """
    extra = "".join(f", {c} AS {c}" for c in keep)
    best = scored.where(F.col(score).isNotNull()).groupBy(*group, "account_id").agg(
        F.expr(f"min_by(struct(offer_id, offer_type, {score} AS score{extra}), struct(-{score}, offer_id)) AS best"))
    return best.select(*group, "account_id", "best.*")


def recommend(scored: DataFrame, budget: int, temperature: float = 0.0, seed: int = 42) -> DataFrame:
    """Best offer per customer, customers ordered by softmax draw, cut at the budget."""
    best = best_offer_per_customer(scored)
    if temperature > 0:
        best = written(best, "best")  # the scaling reads it twice
    best = softmax_key(best, temperature, seed, "score", PAIR)
    return top(best, best_first("order_key", PAIR), budget).select(*RECOMMENDATION_COLUMNS)


def add_hash_score(df: DataFrame, seed: int, name: str = "score_random") -> DataFrame:
    # A column of its own, as the hash reads the text once a character.
    keyed = df.withColumn("_text", F.concat_ws("|", "account_id", "offer_id"))
    return keyed.select(*df.columns, fnv_uniform(seed, F.col("_text")).alias(name))


def eligible(matrix: DataFrame, offer_types: Sequence[str], quadrants: Sequence[str],
             segments: DataFrame | None = None, allowed_segments: Sequence[str] = ()) -> DataFrame:
    """Rows of the chosen types and quadrants, and of the chosen customer segments if given."""
    kept = matrix.where(F.col("offer_type").isin(*offer_types) & F.col("quadrant").isin(*quadrants))
    if segments is None:
        return kept
    members = segments.where(F.col("segment").isin(*allowed_segments)).select("account_id").distinct()
    return kept.join(members, "account_id", "left_semi")


def allocate(rows: DataFrame, budget: int, seed: int, strategies: Sequence[str] = (RANDOM, CONVERSION, UPLIFT),
             temperature: float = 0.0) -> DataFrame:
    """Top customers of each strategy under one filter, one offer per customer.

    `rows` are the eligible matrix rows. Temperature applies to the uplift strategy only.
    """
    pairs = ", ".join(f"struct('{s}' AS strategy, {STRATEGY_COLUMNS[s]} AS score)" for s in strategies)
    keep = ("uplift", "p_convert", "quadrant")
    long = add_hash_score(rows, seed).selectExpr("account_id", "offer_id", "offer_type", *keep, f"inline(array({pairs}))")
    best = written(best_offer_per_customer(long, "score", ["strategy"], keep), "best")  # the ranking reads it twice
    if temperature > 0 and UPLIFT in strategies:
        drawn = softmax_key(best.where(F.col("strategy") == UPLIFT), temperature, seed, "score", PAIR)
        plain = best.where(F.col("strategy") != UPLIFT).withColumn("order_key", F.col("score"))
        best = plain.unionByName(drawn)
    else:
        best = best.withColumn("order_key", F.col("score"))
    ranked = numbered(best, best_first("order_key", PAIR), ["strategy"])
    return ranked.where(F.col("rank") <= budget).drop("order_key")


def audience_size(rows: DataFrame, budget: int, strategies: Sequence[str] = (RANDOM, CONVERSION, UPLIFT)) -> DataFrame:
    """Customers available to each strategy, how many are sent to, and whether the audience ran out."""
    counts = [
        F.expr(f"count(DISTINCT CASE WHEN {'true' if s == RANDOM else STRATEGY_COLUMNS[s] + ' IS NOT NULL'}"
               f" THEN account_id END) AS n_{s}") for s in strategies]
    rows_sql = ", ".join(f"struct('{s}' AS strategy, n_{s} AS eligible)" for s in strategies)
    return rows.agg(*counts).selectExpr(f"inline(array({rows_sql}))").selectExpr(
        "*", f"{int(budget)}L AS budget", f"least(eligible, {int(budget)}L) AS sent", f"eligible < {int(budget)} AS exhausted")


def conversion_means(holdout: DataFrame) -> DataFrame:
    """One row: mean profit and revenue of converted treated rows (0 when there is none)."""
    hit = "treatment = 1 AND converted = 1"
    return holdout.agg(
        F.expr(f"coalesce(avg(CASE WHEN {hit} THEN net_profit END), 0D) AS mean_profit"),
        F.expr(f"coalesce(avg(CASE WHEN {hit} THEN conversion_value END), 0D) AS mean_revenue"))


def project(audience: DataFrame, offers: DataFrame, means: DataFrame, group: Sequence[str] = ("strategy",)) -> DataFrame:
    """Expected totals of an audience; missing model values count as 0."""
    discounts = offers.selectExpr("id AS offer_id", "CAST(discount_value AS DOUBLE) AS discount")
    sums = audience.join(discounts, "offer_id", "left").groupBy(*group).agg(
        F.expr("count(1) AS sent"),
        F.expr("coalesce(sum(p_convert), 0D) AS expected_conversions"),
        F.expr("coalesce(sum(uplift), 0D) AS incremental_conversions"),
        F.expr("coalesce(sum(p_convert * discount), 0D) AS expected_discount"))
    return sums.crossJoin(means).selectExpr(
        *group, "sent", "expected_conversions", "expected_conversions * mean_revenue AS expected_revenue",
        "incremental_conversions", "incremental_conversions * mean_profit AS projected_profit", "expected_discount")


def quadrant_mix(audience: DataFrame, means: DataFrame) -> DataFrame:
    """Client share and projected profit per strategy and quadrant."""
    sums = audience.groupBy("strategy", "quadrant").agg(
        F.expr("count(1) AS clients"), F.expr("coalesce(sum(uplift), 0D) AS incremental"))
    total = Window.partitionBy("strategy")  # at most four rows per strategy
    return sums.withColumn("client_share", F.col("clients") / F.sum("clients").over(total)).crossJoin(means).selectExpr(
        "strategy", "quadrant", "clients", "client_share", "incremental * mean_profit AS projected_profit")


def measured_gain(holdout: DataFrame, offer_types: Sequence[str], quadrants: Sequence[str],
                  budgets: Sequence[int]) -> DataFrame:
    """Gain of the three strategies on the equally filtered holdout, at each budget."""
    kept = eligible(holdout, offer_types, quadrants)
    return at_budgets(gain_curves(kept, STRATEGY_COLUMNS), budgets)


def sent_offers(offers: DataFrame, receipts: DataFrame) -> DataFrame:
    """Catalogue rows of the offers that have ever been sent: the active ones."""
    return offers.join(receipts.select(F.col("offer_id").alias("id")).distinct(), "id", "left_semi").select(*offers.columns)


def paid_offers(offers: DataFrame) -> DataFrame:
    """Catalogue rows of the types that are worth a recommendation."""
    return offers.where(F.col("offer_type").isin(*PAID_TYPES))
