"""Data-quality checks. Each returns (check, rows, fraction); `require_clean` raises on any hit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offertide.operators import clean
from offertide.operators.contract import COLUMNS, NULLABLE
from offertide.settings import BOUGHT, EVENT_KINDS, GRAIN, INFORMATIONAL, PAID_TYPES, SENT, Settings


def violations(df: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """Rows matching each condition, all counted in one pass."""
    counts = [F.expr(f"count_if({c}) AS c{i}") for i, c in enumerate(conditions.values())]
    rows = ", ".join(f"struct('{name}' AS check, c{i} AS rows)" for i, name in enumerate(conditions))
    return (
        df.agg(F.expr("count(1) AS total"), *counts)
        .selectExpr("total", f"inline(array({rows}))")
        .selectExpr("check", "rows", "try_divide(rows, total) AS fraction")
    )


def require_clean(checks: DataFrame) -> None:
    """Raise if any check found a row. The table holds one row per check."""
    found = checks.where("rows > 0").collect()
    if found:
        raise ValueError("quality checks failed: " + "; ".join(f"{r['check']}={r['rows']}" for r in found))


def duplicate_grain(df: DataFrame, keys: tuple[str, ...] = GRAIN) -> DataFrame:
    """Keys that occur more than once."""
    return violations(df.groupBy(*keys).agg(F.expr("count(1) AS copies")), {"duplicate grain": "copies > 1"})


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per contract column and whether they are allowed there."""
    counts = [F.expr(f"count_if({c} IS NULL) AS {c}") for c in COLUMNS]
    rows = ", ".join(
        f"struct('{c}' AS column, {c} AS nulls, {str(c in NULLABLE).lower()} AS allowed)" for c in COLUMNS
    )
    return df.agg(*counts).selectExpr(f"inline(array({rows}))")


def unexpected_nulls(df: DataFrame, strict: bool = False) -> DataFrame:
    """Null counts of the columns that must not be null."""
    found = null_counts(df).where("NOT allowed").selectExpr("column AS check", "nulls AS rows")
    if strict:
        require_clean(found)
    return found


def value_domains(df: DataFrame) -> DataFrame:
    """Domain of every contract column over the whole table."""
    binary = ("treatment", "converted", "is_recurrent", "identity_missing", "hist_completed_unseen_flag",
              "channel_web", "channel_email", "channel_mobile", "channel_social")
    counts = tuple(c for c in COLUMNS if c.startswith(("hist_offers", "hist_txn"))) + (
        "campaign_wave", "n_channels", "n_concurrent_offers")
    amounts = ("received_time", "conversion_value", "reward_cost", "hist_spend_total", "hist_avg_ticket",
               "hist_spend_std", "hist_frequency", "hist_view_rate", "hist_conv_rate_bogo",
               "hist_conv_rate_discount", "discount_value", "min_value", "duration",
               "discount_to_minvalue_ratio")
    kinds = ", ".join(f"'{k}'" for k in (*PAID_TYPES, INFORMATIONAL))
    rules = {f"{c} not binary": f"{c} NOT IN (0, 1)" for c in binary}
    rules |= {f"{c} negative": f"{c} < 0" for c in (*counts, *amounts)}
    rules |= {f"{c} not a number": f"isnan({c})" for c in amounts}
    rules["offer_type unknown"] = f"offer_type NOT IN ({kinds})"
    rules["empty key"] = "account_id = '' OR offer_id = ''"
    return violations(df, rules)


def load_checks(events: DataFrame, offers: DataFrame, profile_raw: DataFrame) -> DataFrame:
    """Sources not empty, with the expected columns and only known event kinds."""
    expected = {
        "events": (events, {"account_id", "event", "time", "offer_ref", "amount", "reward"}),
        "offers": (offers, {"id", "offer_type", "min_value", "discount_value", "duration", "channels"}),
        "profile": (profile_raw, {"id", "age", "gender", "credit_card_limit", "registered_on"}),
    }
    parts = []
    for name, (df, columns) in expected.items():
        wrong = len(columns ^ set(df.columns))
        unknown = ""
        if name == "events":
            kinds = ", ".join(f"'{k}'" for k in EVENT_KINDS)
            unknown = f", struct('unknown event kinds' AS check, unknown AS rows)"
            agg = [F.expr("count(1) AS n"), F.expr(f"count_if(event NOT IN ({kinds}) OR event IS NULL) AS unknown")]
        else:
            agg = [F.expr("count(1) AS n")]
        parts.append(df.agg(*agg).selectExpr(
            "n", f"inline(array(struct('{name} empty' AS check, IF(n = 0, 1L, 0L) AS rows),"
            f" struct('{name} unexpected columns' AS check, {wrong}L AS rows){unknown}))"
        ).selectExpr("check", "rows", "try_divide(rows, n) AS fraction"))
    return _stack(parts)


def profile_checks(profile_raw: DataFrame, profile: DataFrame, cfg: Settings) -> DataFrame:
    rules = violations(profile, {
        "account_id null": "account_id IS NULL",
        "identity_missing not binary": "identity_missing NOT IN (0, 1)",
        "flagged but age present": "identity_missing = 1 AND age IS NOT NULL",
        "sentinel age left": f"identity_missing = 0 AND age = {cfg.age_sentinel}",
        "gender null": "gender IS NULL",
        "tenure null": "tenure_days IS NULL",
    })
    repeated = violations(profile.groupBy("account_id").agg(F.expr("count(1) AS n")),
                          {"account_id repeated": "n > 1"})
    raw = profile_raw.agg(F.expr("count(1) AS n"), F.expr(f"count_if(age = {cfg.age_sentinel}) AS s"))
    new = profile.agg(F.expr("count(1) AS m"), F.expr("count_if(identity_missing = 1) AS f"))
    totals = raw.crossJoin(new).selectExpr(
        "m", "inline(array(struct('rows not preserved' AS check, abs(n - m) AS rows),"
        " struct('sentinel count differs' AS check, abs(s - f) AS rows)))"
    ).selectExpr("check", "rows", "try_divide(rows, m) AS fraction")
    return _stack([rules, repeated, totals])


def attribution_checks(events: DataFrame, offers: DataFrame, attributed: DataFrame) -> DataFrame:
    rules = violations(attributed, {
        "key null": "account_id IS NULL OR offer_id IS NULL",
        "count not 0 or 1": "assigned_txn_count NOT IN (0, 1)",
        "view outside validity": "view_time < received_time OR view_time > valid_until",
        "amount or time without purchase":
            "assigned_txn_count = 0 AND (assigned_txn_amount_sum <> 0 OR first_assigned_txn_time IS NOT NULL)",
        "purchase without amount or time":
            "assigned_txn_count = 1 AND (assigned_txn_amount_sum <= 0 OR first_assigned_txn_time IS NULL)",
        "purchase outside validity":
            "first_assigned_txn_time < received_time OR first_assigned_txn_time > valid_until",
    })
    unknown = attributed.join(offers.selectExpr("id AS offer_id"), "offer_id", "left_anti")
    missing = _share(unknown, attributed, "offer not in catalogue")
    preserved = _same_rows(events.where(F.col("event") == SENT), attributed)
    return _stack([rules, missing, duplicate_grain(attributed), preserved])


def label_checks(labelled: DataFrame, offers: DataFrame) -> DataFrame:
    minimum = offers.selectExpr("id AS offer_id", "CAST(min_value AS DOUBLE) AS least")
    return violations(labelled.join(minimum, "offer_id", "left"), {
        "converted not binary": "converted NOT IN (0, 1)",
        "converted without purchase": "converted = 1 AND assigned_txn_count <> 1",
        "purchase without conversion": "converted = 0 AND assigned_txn_count <> 0",
        "value without conversion": "converted = 0 AND conversion_value <> 0",
        "conversion without value": "converted = 1 AND conversion_value <= 0",
        "value differs from purchase": "converted = 1 AND conversion_value <> assigned_txn_amount_sum",
        "value below minimum": "converted = 1 AND conversion_value < least",
    })


def feature_checks(featured: DataFrame) -> DataFrame:
    counts = ("hist_txn_count", "hist_offers_received", "hist_offers_viewed", "hist_offers_completed",
              "hist_offers_received_bogo", "hist_offers_received_discount", "hist_offers_received_info",
              "n_concurrent_offers", "n_channels")
    flags = ("hist_completed_unseen_flag", "channel_web", "channel_email", "channel_mobile", "channel_social")
    filled = ("hist_spend_total", "hist_avg_ticket", "hist_spend_std", "hist_frequency", "hist_spend_trend",
              "discount_to_minvalue_ratio")
    rates = ("hist_view_rate", "hist_conv_rate_bogo", "hist_conv_rate_discount")
    rules = {f"{c} null or negative": f"{c} IS NULL OR {c} < 0" for c in (*counts, *rates)}
    rules |= {f"{c} not binary": f"{c} IS NULL OR {c} NOT IN (0, 1)" for c in flags}
    rules |= {f"{c} null": f"{c} IS NULL" for c in filled}
    rules["recency not positive"] = "hist_recency_days <= 0"
    rules["recurrent not binary"] = "is_recurrent NOT IN (0, 1)"
    rules["recurrent without conversion"] = "is_recurrent = 1 AND converted <> 1"
    return violations(featured, rules)


def cost_checks(priced: DataFrame) -> DataFrame:
    paid = ", ".join(f"'{t}'" for t in PAID_TYPES)
    return violations(priced, {
        "cost negative": "reward_cost < 0",
        "cost without conversion": "converted = 0 AND reward_cost <> 0",
        "cost on informational": f"offer_type = '{INFORMATIONAL}' AND reward_cost <> 0",
        "cost on unpaid type": f"reward_cost > 0 AND offer_type NOT IN ({paid})",
        "cost differs from discount":
            f"converted = 1 AND offer_type IN ({paid}) AND reward_cost <> discount_value",
    })


def assembly_checks(assembled: DataFrame, expected_waves: int) -> DataFrame:
    rules = violations(assembled, {
        "profile missing": "age IS NULL AND coalesce(identity_missing, 0) = 0",
        "treatment differs from view": "(treatment = 1) <> (view_time IS NOT NULL)",
        "treatment not binary": "treatment NOT IN (0, 1)",
    })
    # One row per send time: waves must be 0, 1, 2, ... in time order.
    waves = assembled.groupBy("received_time").agg(
        F.expr("min(campaign_wave) AS lo"), F.expr("max(campaign_wave) AS hi"))
    spread = waves.agg(F.expr("count(1) AS n"), F.expr("count(DISTINCT lo) AS d"),
                       F.expr("min(lo) AS first"), F.expr("max(hi) AS last"), F.expr("count_if(lo <> hi) AS split"))
    order = spread.selectExpr(
        "n", "inline(array("
        "struct('waves not contiguous' AS check, IF(n = d AND first = 0 AND last = n - 1 AND split = 0, 0L, 1L) AS rows),"
        f"struct('wave count unexpected' AS check, abs(n - {expected_waves}L) AS rows)))"
    ).selectExpr("check", "rows", "try_divide(rows, n) AS fraction")
    return _stack([rules, order])


def impossible_combinations(processed: DataFrame, cfg: Settings) -> DataFrame:
    """Nine combinations that should not occur; counted, not asserted."""
    return violations(processed, {
        "converted without value": "converted = 1 AND conversion_value <= 0",
        "value without conversion": "conversion_value > 0 AND converted = 0",
        "cost without conversion": "reward_cost > 0 AND converted = 0",
        "cost on informational": f"reward_cost > 0 AND offer_type = '{INFORMATIONAL}'",
        "cost above value": "converted = 1 AND reward_cost > conversion_value",
        "ticket without purchases": "hist_avg_ticket > 0 AND hist_txn_count = 0",
        "negative spend": "hist_spend_total < 0",
        "view rate outside 0 to 1": "hist_view_rate < 0 OR hist_view_rate > 1",
        "sentinel age": f"age = {cfg.age_sentinel}",
    })


def paid_below_minimum(processed: DataFrame) -> DataFrame:
    """Paid conversions below the minimum spend or costing more than they brought, by type."""
    below = "conversion_value < min_value"
    return (
        processed.where(f"converted = 1 AND offer_type <> '{INFORMATIONAL}'").groupBy("offer_type")
        .agg(
            F.expr("count(1) AS paid_conversions"),
            F.expr(f"count_if({below}) AS below_minimum"),
            F.expr("count_if(reward_cost > conversion_value) AS cost_above_value"),
            F.expr("sum(reward_cost) AS total_cost"),
            F.expr(f"sum(IF({below}, reward_cost, 0D)) AS suspect_cost"),
        )
        .selectExpr("*", "try_divide(below_minimum, paid_conversions) AS below_fraction",
                    "try_divide(suspect_cost, total_cost) AS suspect_fraction")
    )


def missing_identity_overlap(profile_raw: DataFrame, cfg: Settings) -> DataFrame:
    """How the three missing profile fields coincide."""
    old, no_gender, no_limit = f"age = {cfg.age_sentinel}", "gender IS NULL", "credit_card_limit IS NULL"
    return violations(profile_raw, {
        "age sentinel": old,
        "gender missing": no_gender,
        "limit missing": no_limit,
        "all three": f"{old} AND {no_gender} AND {no_limit}",
        "any of them": f"({old}) OR {no_gender} OR {no_limit}",
    })


def raw_quality(events: DataFrame, profile_raw: DataFrame, unseen: DataFrame, outside: DataFrame,
                cfg: Settings) -> DataFrame:
    """Missing references, unseen completions, spontaneous purchases, sentinels and duplicates.

    `unseen` is the per-type table of unseen completions, `outside` the table of
    purchases inside and outside any offer window.
    """
    references = events.agg(
        F.expr(f"count_if(event = '{BOUGHT}') AS bought"),
        F.expr(f"count_if(event = '{BOUGHT}' AND offer_ref IS NULL) AS bought_without"),
        F.expr(f"count_if(event <> '{BOUGHT}') AS campaign"),
        F.expr(f"count_if(event <> '{BOUGHT}' AND offer_ref IS NULL) AS campaign_without"),
    ).selectExpr(
        "inline(array(struct('purchases without reference' AS metric, bought_without AS part, bought AS whole),"
        " struct('campaign events without reference' AS metric, campaign_without AS part, campaign AS whole)))"
    )
    copies = events.groupBy("account_id", "event", "time", "offer_ref").agg(F.expr("count(1) AS n"))
    repeated = copies.selectExpr("IF(n > 1, 1L, 0L) AS extra", "n").agg(
        F.expr("sum(extra) AS part"), F.expr("sum(n) AS whole")
    ).selectExpr("'repeated raw rows' AS metric", "part", "whole")
    silent = unseen.agg(F.expr("sum(unseen) AS part"), F.expr("sum(completed) AS whole")).selectExpr(
        "'completions without earlier view' AS metric", "part", "whole")
    spontaneous = outside.agg(
        F.expr("sum(IF(place = 'outside any window', transactions, 0L)) AS part"),
        F.expr("sum(transactions) AS whole"),
    ).selectExpr("'purchases outside any window' AS metric", "part", "whole")
    sentinel = profile_raw.agg(
        F.expr(f"count_if(age = {cfg.age_sentinel}) AS part"), F.expr("count(1) AS whole")
    ).selectExpr("'profiles with sentinel age' AS metric", "part", "whole")
    return _stack([references, silent, spontaneous, sentinel, repeated]).selectExpr(
        "*", "try_divide(part, whole) AS rate")


def temporal_order(train: DataFrame, holdout: DataFrame, strict: bool = False) -> DataFrame:
    """Last training receipt before the first holdout receipt, and neither side empty."""
    bounds = train.agg(F.expr("max(received_time) AS last_train")).crossJoin(
        holdout.agg(F.expr("min(received_time) AS first_holdout")))
    out = bounds.selectExpr("*", "coalesce(last_train < first_holdout, false) AS in_order")
    if strict:
        row = out.first()
        if row["last_train"] is None or row["first_holdout"] is None:
            raise ValueError("one side of the temporal split is empty")
        if not row["in_order"]:
            raise ValueError(f"training reaches {row['last_train']}, holdout starts at {row['first_holdout']}")
    return out


def stage_summary(profile_raw: DataFrame, events: DataFrame, assembled: DataFrame, cfg: Settings) -> DataFrame:
    """Rows and flag counts of each preparation stage, one pass per table."""

    def stage(df: DataFrame, name: str, measures: dict[str, str]) -> DataFrame:
        aggs = [F.expr(f"CAST({sql} AS DOUBLE) AS m{i}") for i, sql in enumerate(measures.values())]
        rows = ", ".join(f"struct('{m}' AS measure, m{i} AS value)" for i, m in enumerate(measures))
        return df.agg(*aggs).selectExpr(f"'{name}' AS stage", f"inline(array({rows}))")

    profile = stage(profile_raw, "profile", {
        "rows": "count(1)", "sentinel": f"count_if(age = {cfg.age_sentinel})",
        "unknown gender": "count_if(gender IS NULL)",
    })
    log = stage(events, "log", {"rows": "count(1)", "receipts": f"count_if(event = '{SENT}')"})
    # The stages after attribution share the grain, so one pass serves all of them.
    grain = stage(assembled, "grain", {
        "rows": "count(1)", "with view": "count(view_time)",
        "with purchase": "count_if(assigned_txn_count = 1)", "converted": "sum(converted)",
        "converted unseen": "count_if(converted = 1 AND view_time IS NULL)",
        "recurrent": "sum(is_recurrent)", "empty history": "count_if(hist_txn_count = 0)",
        "with cost": "count_if(reward_cost > 0)", "total cost": "sum(reward_cost)",
        "treated": "count_if(treatment = 1)", "control": "count_if(treatment = 0)",
        "control converted": "count_if(treatment = 0 AND converted = 1)",
        "waves": "count(DISTINCT campaign_wave)",
    })
    return _stack([profile, log, grain])


def _share(part: DataFrame, whole: DataFrame, name: str) -> DataFrame:
    return part.agg(F.expr("count(1) AS rows")).crossJoin(whole.agg(F.expr("count(1) AS n"))).selectExpr(
        f"'{name}' AS check", "rows", "try_divide(rows, n) AS fraction")


def _same_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.agg(F.expr("count(1) AS n")).crossJoin(after.agg(F.expr("count(1) AS m"))).selectExpr(
        "'rows not preserved' AS check", "abs(n - m) AS rows", "try_divide(abs(n - m), n) AS fraction")


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
