"""Data-quality checks."""

from __future__ import annotations

from offertide.operators import clean, contract, describe, features, quality
from offertide.operators.attribution import attribute, build_label
from offertide.registry.core import query


def checks(table: str, **conditions: str) -> str:
    """SQL of a check table: name with spaces for underscores -> condition."""
    parts = [
        f"""SELECT '{name}' AS "check", count(*) FILTER ({sql}) AS rows,
  CASE WHEN count(*) > 0 THEN count(*) FILTER ({sql}) / count(*) END AS fraction FROM {table}"""
        for name, sql in conditions.items()
    ]
    return " UNION ALL ".join(parts)


def named(table: str, conditions: dict[str, str]) -> str:
    return checks(table, **conditions)


_DUPLICATES = named("(SELECT count(*) AS n FROM {t} GROUP BY account_id, offer_id, received_time)",
                    {"duplicate grain": "n > 1"})


@query("d1_unique_grain", _DUPLICATES.format(t="processed"), "fraction")
def _(w):
    return quality.duplicate_grain(w.processed)


_TYPES = {"string": "string", "integer": "int", "double": "double"}


@query("d2_schema", " UNION ALL ".join(
    f"""SELECT {i} AS position, '{f.name}' AS "column", '{_TYPES[f.dataType.typeName()]}' AS expected, '{_TYPES[f.dataType.typeName()]}' AS found,
  count({f.name}) AS filled, false AS differs FROM processed""" for i, f in enumerate(contract.PROCESSED_SCHEMA.fields)))
def _(w):
    return contract.column_report(w.processed)


_NULLS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS nulls, {str(c in contract.NULLABLE).lower()} AS allowed FROM processed"""
    for c in contract.COLUMNS)


@query("d3_null_counts", _NULLS)
def _(w):
    return quality.null_counts(w.processed)


@query("d3_unexpected_nulls", f"""SELECT "column" AS "check", nulls AS rows FROM ({_NULLS}) WHERE NOT allowed""")
def _(w):
    return quality.unexpected_nulls(w.processed)


_BINARY = ("treatment converted is_recurrent identity_missing hist_completed_unseen_flag "
           "channel_web channel_email channel_mobile channel_social").split()
_NOT_NEGATIVE = ("hist_txn_count hist_offers_received hist_offers_received_bogo hist_offers_received_discount "
                 "hist_offers_received_info hist_offers_viewed hist_offers_completed campaign_wave n_channels "
                 "n_concurrent_offers").split()
_AMOUNTS = ("received_time conversion_value reward_cost hist_spend_total hist_avg_ticket hist_spend_std "
            "hist_frequency hist_view_rate hist_conv_rate_bogo hist_conv_rate_discount discount_value "
            "min_value duration discount_to_minvalue_ratio").split()


@query("d4_value_domains", named("processed", {
    **{f"{c} not binary": f"{c} <> 0 AND {c} <> 1" for c in _BINARY},
    **{f"{c} negative": f"{c} < 0" for c in _NOT_NEGATIVE + _AMOUNTS},
    **{f"{c} not a number": f"isnan({c})" for c in _AMOUNTS},
    "offer_type unknown": "offer_type NOT IN ('bogo', 'discount', 'informational')",
    "empty key": "account_id = '' OR offer_id = ''",
}), "fraction")
def _(w):
    return quality.value_domains(w.processed)


@query("d5_load_checks", """
SELECT name || ' empty' AS "check", CASE WHEN n = 0 THEN 1 ELSE 0 END::BIGINT AS rows, CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS fraction
FROM (SELECT 'events' AS name, count(*) AS n FROM log UNION ALL SELECT 'offers', count(*) FROM offers UNION ALL SELECT 'profile', count(*) FROM raw_profile)
UNION ALL SELECT name || ' unexpected columns', 0, 0.0 FROM (VALUES ('events'), ('offers'), ('profile')) v(name)
UNION ALL SELECT 'unknown event kinds', count(*) FILTER (event NOT IN ('offer received', 'offer viewed', 'offer completed', 'transaction')),
  count(*) FILTER (event NOT IN ('offer received', 'offer viewed', 'offer completed', 'transaction')) / count(*) FROM log""", "fraction")
def _(w):
    return quality.load_checks(w.log, w.offers, w.raw_profile)


@query("d6_profile_checks", named("profile", {
    "account_id null": "account_id IS NULL", "identity_missing not binary": "identity_missing NOT IN (0, 1)",
    "flagged but age present": "identity_missing = 1 AND age IS NOT NULL",
    "sentinel age left": "identity_missing = 0 AND age = 118",
    "gender null": "gender IS NULL", "tenure null": "tenure_days IS NULL",
}) + " UNION ALL " + named("(SELECT count(*) AS n FROM profile GROUP BY account_id)", {"account_id repeated": "n > 1"}) + """
UNION ALL SELECT 'rows not preserved', abs((SELECT count(*) FROM raw_profile) - count(*)), abs((SELECT count(*) FROM raw_profile) - count(*)) / count(*) FROM profile
UNION ALL SELECT 'sentinel count differs', abs((SELECT count(*) FROM raw_profile WHERE age = 118) - count(*) FILTER (identity_missing = 1)),
  abs((SELECT count(*) FROM raw_profile WHERE age = 118) - count(*) FILTER (identity_missing = 1)) / count(*) FROM profile""", "fraction")
def _(w):
    return quality.profile_checks(w.raw_profile, w.profile, w.cfg)


@query("d7_attribution_checks", named("attributed", {
    "key null": "account_id IS NULL OR offer_id IS NULL", "count not 0 or 1": "assigned_txn_count > 1",
    "view outside validity": "view_time < received_time OR view_time > valid_until",
    "amount or time without purchase": "assigned_txn_count = 0 AND (assigned_txn_amount_sum <> 0 OR first_assigned_txn_time IS NOT NULL)",
    "purchase without amount or time": "assigned_txn_count = 1 AND (assigned_txn_amount_sum <= 0 OR first_assigned_txn_time IS NULL)",
    "purchase outside validity": "first_assigned_txn_time < received_time OR first_assigned_txn_time > valid_until",
    "offer not in catalogue": "offer_id NOT IN (SELECT id FROM offers)",
}) + " UNION ALL " + _DUPLICATES.format(t="attributed") + """
UNION ALL SELECT 'rows not preserved', abs(count(*) - (SELECT count(*) FROM attributed)), abs(count(*) - (SELECT count(*) FROM attributed)) / count(*) FROM receipts""", "fraction")
def _(w):
    return quality.attribution_checks(w.log, w.offers, attribute(w.log, w.offers, w.cfg, w.hot))


@query("d8_label_checks", named("(SELECT l.*, o.min_value FROM labelled l LEFT JOIN offers o ON o.id = l.offer_id)", {
    "converted not binary": "converted NOT IN (0, 1)", "converted without purchase": "converted = 1 AND assigned_txn_count <> 1",
    "purchase without conversion": "converted = 0 AND assigned_txn_count <> 0", "value without conversion": "converted = 0 AND conversion_value <> 0",
    "conversion without value": "converted = 1 AND conversion_value <= 0",
    "value differs from purchase": "converted = 1 AND conversion_value <> assigned_txn_amount_sum",
    "value below minimum": "converted = 1 AND conversion_value < min_value",
}), "fraction")
def _(w):
    return quality.label_checks(build_label(attribute(w.log, w.offers, w.cfg, w.hot)), w.offers)


@query("d9_feature_checks", named("processed", {
    **{f"{c} null or negative": f"{c} IS NULL OR {c} < 0" for c in
       ("hist_txn_count hist_offers_received hist_offers_viewed hist_offers_completed hist_offers_received_bogo "
        "hist_offers_received_discount hist_offers_received_info n_concurrent_offers n_channels "
        "hist_view_rate hist_conv_rate_bogo hist_conv_rate_discount").split()},
    **{f"{c} not binary": f"coalesce({c}, 2) > 1" for c in
       "hist_completed_unseen_flag channel_web channel_email channel_mobile channel_social".split()},
    **{f"{c} null": f"{c} IS NULL" for c in
       "hist_spend_total hist_avg_ticket hist_spend_std hist_frequency hist_spend_trend discount_to_minvalue_ratio".split()},
    "recency not positive": "hist_recency_days <= 0", "recurrent not binary": "is_recurrent NOT IN (0, 1)",
    "recurrent without conversion": "is_recurrent = 1 AND converted = 0",
}), "fraction")
def _(w):
    return quality.feature_checks(w.assembled)


@query("d10_cost_checks", named("processed", {
    "cost negative": "reward_cost < 0", "cost without conversion": "converted = 0 AND reward_cost <> 0",
    "cost on informational": "offer_type = 'informational' AND reward_cost <> 0",
    "cost on unpaid type": "reward_cost > 0 AND offer_type NOT IN ('bogo', 'discount')",
    "cost differs from discount": "converted = 1 AND offer_type IN ('bogo', 'discount') AND reward_cost <> discount_value",
}), "fraction")
def _(w):
    return quality.cost_checks(w.assembled)


@query("d11_assembly_checks", named("processed", {
    "profile missing": "age IS NULL AND coalesce(identity_missing, 0) = 0",
    "treatment differs from view": "(treatment = 1) <> (view_time IS NOT NULL)",
    "treatment not binary": "treatment NOT IN (0, 1)",
}) + """
UNION ALL SELECT 'waves not contiguous', count(*) FILTER (campaign_wave <> k), count(*) FILTER (campaign_wave <> k) / count(*)
  FROM (SELECT received_time, campaign_wave, dense_rank() OVER (ORDER BY received_time) - 1 AS k FROM (SELECT DISTINCT received_time, campaign_wave FROM processed))
UNION ALL SELECT 'wave count unexpected', abs(count(DISTINCT received_time) - 6), abs(count(DISTINCT received_time) - 6) / count(DISTINCT received_time) FROM processed""", "fraction")
def _(w):
    return quality.assembly_checks(w.assembled, w.cfg.n_campaign_waves)


@query("d12_impossible_combinations", named("processed", {
    "converted without value": "converted = 1 AND conversion_value <= 0", "value without conversion": "conversion_value > 0 AND converted = 0",
    "cost without conversion": "reward_cost > 0 AND converted = 0", "cost on informational": "reward_cost > 0 AND offer_type = 'informational'",
    "cost above value": "converted = 1 AND reward_cost > conversion_value", "ticket without purchases": "hist_avg_ticket > 0 AND hist_txn_count = 0",
    "negative spend": "hist_spend_total < 0", "view rate outside 0 to 1": "hist_view_rate NOT BETWEEN 0 AND 1", "sentinel age": "age = 118",
}), "fraction")
def _(w):
    return quality.impossible_combinations(w.processed, w.cfg)


@query("d13_paid_below_minimum", """
SELECT offer_type, count(*) AS paid_conversions, count(*) FILTER (conversion_value < min_value) AS below_minimum,
  count(*) FILTER (reward_cost > conversion_value) AS cost_above_value, sum(reward_cost) AS total_cost,
  coalesce(sum(reward_cost) FILTER (conversion_value < min_value), 0.0) AS suspect_cost,
  count(*) FILTER (conversion_value < min_value) / count(*) AS below_fraction,
  coalesce(sum(reward_cost) FILTER (conversion_value < min_value), 0.0) / sum(reward_cost) AS suspect_fraction
FROM processed WHERE converted = 1 AND offer_type <> 'informational' GROUP BY 1""",
       "total_cost suspect_cost below_fraction suspect_fraction")
def _(w):
    return quality.paid_below_minimum(w.processed)


@query("d14_missing_identity_overlap", named("raw_profile", {
    "age sentinel": "age = 118", "gender missing": "gender IS NULL", "limit missing": "credit_card_limit IS NULL",
    "all three": "age = 118 AND gender IS NULL AND credit_card_limit IS NULL",
    "any of them": "age = 118 OR gender IS NULL OR credit_card_limit IS NULL",
}), "fraction")
def _(w):
    return quality.missing_identity_overlap(w.raw_profile, w.cfg)


@query("d15_raw_quality", """
SELECT metric, part::BIGINT AS part, whole::BIGINT AS whole, part / whole AS rate FROM (
  SELECT 'purchases without reference' AS metric, count(*) FILTER (offer_ref IS NULL) AS part, count(*) AS whole FROM log WHERE event = 'transaction'
  UNION ALL SELECT 'campaign events without reference', count(*) FILTER (offer_ref IS NULL), count(*) FROM log WHERE event <> 'transaction'
  UNION ALL SELECT 'completions without earlier view', count(*) FILTER (last_view IS NULL), count(*) FROM finished
  UNION ALL SELECT 'purchases outside any window', count(*) FILTER (NOT EXISTS (SELECT 1 FROM validity v
    WHERE v.account_id = t.account_id AND t.txn_time BETWEEN v.received_time AND v.valid_until)), count(*) FROM txns t
  UNION ALL SELECT 'profiles with sentinel age', count(*) FILTER (age = 118), count(*) FROM raw_profile
  UNION ALL SELECT 'repeated raw rows', count(*) FILTER (n > 1), sum(n) FROM (SELECT count(*) AS n FROM log GROUP BY account_id, event, time, offer_ref)
)""", "rate")
def _(w):
    unseen = describe.unseen_completions(w.log, w.offers, w.hot)
    outside = describe.spontaneous_share(w.log, w.attributed, w.hot)
    return quality.raw_quality(w.log, w.raw_profile, unseen, outside, w.cfg)


@query("d16_temporal_order", """
SELECT (SELECT max(received_time) FROM train) AS last_train, (SELECT min(received_time) FROM holdout) AS first_holdout,
  (SELECT max(received_time) FROM train) < (SELECT min(received_time) FROM holdout) AS in_order""", "last_train first_holdout")
def _(w):
    train, holdout = w.split
    return quality.temporal_order(train, holdout)


@query("d17_stage_summary", """
SELECT 'profile' AS stage, unnest(['rows', 'sentinel', 'unknown gender']) AS measure,
  unnest([count(*)::DOUBLE, count(*) FILTER (age = 118), count(*) FILTER (gender IS NULL)]) AS value FROM raw_profile
UNION ALL SELECT 'log', unnest(['rows', 'receipts']), unnest([count(*)::DOUBLE, count(*) FILTER (event = 'offer received')]) FROM log
UNION ALL SELECT 'grain', unnest(['rows', 'with view', 'with purchase', 'converted', 'converted unseen', 'recurrent', 'empty history',
    'with cost', 'total cost', 'treated', 'control', 'control converted', 'waves']),
  unnest([count(*)::DOUBLE, count(view_time), sum(assigned_txn_count), sum(converted), count(*) FILTER (converted = 1 AND treatment = 0), sum(is_recurrent),
    count(*) FILTER (hist_txn_count = 0), count(*) FILTER (reward_cost > 0), sum(reward_cost), sum(treatment), sum(1 - treatment),
    count(*) FILTER (treatment = 0 AND converted = 1), count(DISTINCT campaign_wave)]) FROM processed""", "value")
def _(w):
    return quality.stage_summary(w.raw_profile, w.log, w.assembled, w.cfg)
