"""Scoring frame, recommendation, allocation and projection on formula scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from offertide.operators import clean, contract, serving
from offertide.registry.core import query
from offertide.registry.describe import SPEND_SEGMENTS, tenure_segments
from offertide.registry.evaluate import QUADRANT_CASE, curve_ctes, dynamic, unit
from offertide.registry.workspace import FORMULA_SCORES
from offertide.settings import PAID_TYPES

_SCORES = ", ".join(f"{sql} AS {n}" for n, sql in FORMULA_SCORES.items())
_HISTORY = """moment AS (SELECT max(time) AS t FROM log),
s_txn AS (SELECT account_id, sum(txn_amount) AS total, count(*) AS n, avg(txn_amount) AS ticket, stddev_samp(txn_amount) AS std, max(txn_time) AS last_time,
  avg(txn_amount) FILTER (txn_time >= t / 2) AS late, avg(txn_amount) FILTER (txn_time < t / 2) AS early FROM txns, moment WHERE txn_time < t GROUP BY 1),
s_resp AS (SELECT e.account_id, count(*) FILTER (event = 'offer received') AS r, count(*) FILTER (event = 'offer viewed') AS v, count(*) FILTER (event = 'offer completed') AS c,
  count(*) FILTER (event = 'offer received' AND offer_type = 'bogo') AS rb, count(*) FILTER (event = 'offer received' AND offer_type = 'discount') AS rd,
  count(*) FILTER (event = 'offer received' AND offer_type = 'informational') AS ri, count(*) FILTER (event = 'offer completed' AND offer_type = 'bogo') AS cb,
  count(*) FILTER (event = 'offer completed' AND offer_type = 'discount') AS cd
  FROM log e JOIN offers o ON o.id = e.offer_ref, moment WHERE e.time < t GROUP BY 1),
s_fin AS (SELECT account_id, max((last_view IS NULL)::INT) AS unseen, avg(completed_time - last_view) AS delay FROM finished, moment WHERE completed_time < t GROUP BY 1),
serving_frame AS MATERIALIZED (
  SELECT p.account_id, o.id AS offer_id, o.offer_type, m.t AS received_time, 0 AS campaign_wave, 1 AS treatment, 0 AS converted, 0.0::DOUBLE AS conversion_value,
    0.0::DOUBLE AS reward_cost, 0 AS is_recurrent, p.age, p.gender, p.credit_card_limit, p.identity_missing, p.tenure_days,
    coalesce(x.total, 0.0) AS hist_spend_total, coalesce(x.n, 0)::INT AS hist_txn_count, coalesce(x.ticket, 0.0) AS hist_avg_ticket, coalesce(x.std, 0.0) AS hist_spend_std,
    m.t - x.last_time AS hist_recency_days, coalesce(x.n, 0) / m.t AS hist_frequency, coalesce(x.late, 0.0) - coalesce(x.early, 0.0) AS hist_spend_trend,
    coalesce(r.r, 0)::INT AS hist_offers_received, coalesce(r.rb, 0)::INT AS hist_offers_received_bogo, coalesce(r.rd, 0)::INT AS hist_offers_received_discount,
    coalesce(r.ri, 0)::INT AS hist_offers_received_info, coalesce(r.v, 0)::INT AS hist_offers_viewed, coalesce(r.c, 0)::INT AS hist_offers_completed,
    CASE WHEN r.r > 0 THEN r.v / r.r ELSE 0.0 END AS hist_view_rate, CASE WHEN r.rb > 0 THEN r.cb / r.rb ELSE 0.0 END AS hist_conv_rate_bogo,
    CASE WHEN r.rd > 0 THEN r.cd / r.rd ELSE 0.0 END AS hist_conv_rate_discount, coalesce(f.unseen, 0)::INT AS hist_completed_unseen_flag, f.delay AS hist_time_view_to_conv,
    o.discount_value, o.min_value, o.duration, len(o.channels)::INT AS n_channels, list_contains(o.channels, 'web')::INT AS channel_web,
    list_contains(o.channels, 'email')::INT AS channel_email, list_contains(o.channels, 'mobile')::INT AS channel_mobile, list_contains(o.channels, 'social')::INT AS channel_social,
    CASE WHEN o.min_value > 0 THEN o.discount_value / o.min_value ELSE 0.0 END AS discount_to_minvalue_ratio, ((SELECT count(*) FROM active) - 1)::INT AS n_concurrent_offers
  FROM profile p CROSS JOIN active o CROSS JOIN moment m
  LEFT JOIN s_txn x USING (account_id) LEFT JOIN s_resp r USING (account_id) LEFT JOIN s_fin f USING (account_id))"""
_MATRIX = _HISTORY + f""",
paid AS (SELECT *, {_SCORES} FROM serving_frame WHERE offer_type <> 'informational'),
matrix AS MATERIALIZED (SELECT account_id, offer_id, offer_type, uplift, p_convert, uncertainty, {dynamic(1.0)} AS score_dynamic, {QUADRANT_CASE} AS quadrant FROM paid
  UNION ALL SELECT account_id, offer_id, offer_type, NULL, NULL, NULL, NULL, NULL FROM serving_frame WHERE offer_type = 'informational')"""
_CONTRACT_DOUBLES = " ".join(f.name for f in contract.PROCESSED_SCHEMA.fields if f.dataType.typeName() == "double")


def fnv(seed: int, text: str) -> str:
    start = (2166136261 ^ seed) & 0xFFFFFFFF
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return (f"(list_reduce(list_concat([{start}::BIGINT], {codes}), lambda h, c: (xor(h, c) * 16777619) & 4294967295) / 4294967296.0::DOUBLE)")


@query("v1_decision_time", "SELECT max(time) AS decision_time FROM log", "decision_time")
def _(w):
    return serving.decision_time(w.log)


@query("v2_scoring_grain", "SELECT p.account_id, o.id AS offer_id, (SELECT max(time) FROM log) AS received_time FROM profile p CROSS JOIN active o", "received_time")
def _(w):
    at = serving.decision_time(w.log).first()[0]
    return serving.scoring_grain(w.profile, w.active, at)


@query("v3_scoring_frame", f"SELECT {', '.join(contract.COLUMNS)} FROM serving_frame", _CONTRACT_DOUBLES, _HISTORY)
def _(w):
    at = serving.decision_time(w.log).first()[0]
    return serving.build_scoring_frame(w.log, w.offers, w.profile, at, w.cfg, w.active, hot=w.hot)


@query("v3_scoring_frame_active", f"""SELECT account_id, offer_id, hist_txn_count, hist_offers_viewed,
  (SELECT count(*) FROM validity v, moment WHERE v.account_id = s.account_id AND t BETWEEN v.received_time AND v.valid_until)::INT AS n_concurrent_offers
FROM serving_frame s WHERE offer_type <> 'informational'""", "", _HISTORY)
def _(w):
    at = serving.decision_time(w.log).first()[0]
    frame = serving.build_scoring_frame(
        w.log, w.offers, w.profile, at, w.cfg, serving.paid_offers(w.active),
        receipts=clean.receipts(w.log), hot=w.hot)
    return frame.select("account_id", "offer_id", "hist_txn_count", "hist_offers_viewed", "n_concurrent_offers")


def _recommend_sql(score: str, order: str, budget: int) -> str:
    return f"""SELECT row_number() OVER (ORDER BY {order} DESC, account_id, offer_id) AS rank, account_id, offer_id, offer_type, score FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY score DESC, offer_id) AS k FROM (SELECT *, {score} AS score FROM matrix) WHERE score IS NOT NULL)
WHERE k = 1 QUALIFY rank <= {budget}"""


@query("v4_recommend", _recommend_sql("uplift + 0.3 * p_convert", "score", 200), "score", _MATRIX)
def _(w):
    return serving.recommend(w.matrix.selectExpr("*", "uplift + 0.3D * p_convert AS score"), 200)


@query("v4_recommend_softmax", f"""SELECT row_number() OVER (ORDER BY key DESC, account_id, offer_id) AS rank, account_id, offer_id, offer_type, score FROM (
  SELECT *, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER () + 1e-9) / 0.1 - ln(-ln({unit(42, "'softmax'", "account_id", "offer_id")})) AS key FROM (
    SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY score DESC, offer_id) AS k FROM (SELECT *, uplift + 0.3 * p_convert AS score FROM matrix) WHERE score IS NOT NULL)
  WHERE k = 1) QUALIFY rank <= 200""", "score", _MATRIX)
def _(w):
    scored = w.matrix.selectExpr("*", "uplift + 0.3D * p_convert AS score")
    return serving.recommend(scored, 200, w.cfg.blend_temperature, w.cfg.seed)


@query("v6_hash_score", f"SELECT account_id, offer_id, {fnv(42, chr(39).join(['account_id || ', '|', ' || offer_id']))} AS score_random FROM matrix",
       "score_random", _MATRIX)
def _(w):
    return serving.add_hash_score(w.matrix, w.cfg.seed).select("account_id", "offer_id", "score_random")


_HASH = fnv(42, "account_id || '|' || offer_id")


@query("v7_scored_holdout", f"""SELECT account_id, offer_type, treatment, converted, net_profit, {_HASH} AS score_random, p_convert,
  {dynamic(1.0)} AS score_dynamic, {QUADRANT_CASE} AS quadrant FROM scored""", "net_profit score_random p_convert score_dynamic")
def _(w):
    return w.scored_holdout.select("account_id", "offer_type", "treatment", "converted", "net_profit", "score_random",
                                   "p_convert", "score_dynamic", "quadrant")


_MEANS = """means AS (SELECT coalesce(avg(net_profit) FILTER (treatment = 1 AND converted = 1), 0.0) AS mean_profit,
  coalesce(avg(conversion_value) FILTER (treatment = 1 AND converted = 1), 0.0) AS mean_revenue FROM scored)"""


@query("v7_conversion_means", "SELECT * FROM means", "mean_profit mean_revenue", _MEANS)
def _(w):
    return serving.conversion_means(w.scored_holdout)


_TYPES, _ALLOWED, _BUDGET = PAID_TYPES, ("persuadable", "sure_thing", "lost_cause"), 150
_FILTERED = f"""filtered AS (SELECT *, {_HASH} AS score_random FROM matrix WHERE offer_type IN ('bogo', 'discount') AND quadrant IN ('persuadable', 'sure_thing', 'lost_cause'))"""


def _allocation(table: str) -> str:
    long = " UNION ALL ".join(
        f"SELECT '{s}' AS strategy, account_id, offer_id, offer_type, uplift, p_convert, quadrant, {c} AS score FROM {table}"
        for s, c in serving.STRATEGY_COLUMNS.items())
    return f"""audience AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY score DESC, account_id, offer_id) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY strategy, account_id ORDER BY score DESC, offer_id) AS k FROM ({long}) WHERE score IS NOT NULL)
  WHERE k = 1 QUALIFY rank <= {_BUDGET})"""


def _audience(w, rows=None):
    rows = serving.eligible(w.matrix, _TYPES, _ALLOWED) if rows is None else rows
    return serving.allocate(rows, _BUDGET, w.cfg.seed)


@query("v8_allocate", "SELECT strategy, rank, account_id, offer_id, offer_type, score FROM audience", "score",
       _MATRIX + ", " + _FILTERED + ", " + _allocation("filtered"))
def _(w):
    return _audience(w).select("strategy", "rank", "account_id", "offer_id", "offer_type", "score")


@query("v9_audience_size", """SELECT strategy, n AS eligible, 1000::BIGINT AS budget, least(n, 1000) AS sent, n < 1000 AS exhausted FROM (
  SELECT unnest(['random', 'conversion', 'uplift']) AS strategy, count(DISTINCT account_id) AS n FROM filtered)""", "", _MATRIX + ", " + _FILTERED)
def _(w):
    return serving.audience_size(serving.eligible(w.matrix, _TYPES, _ALLOWED), 1000)


_PROJECT = """SELECT strategy, count(*) AS sent, sum(p_convert) AS expected_conversions, sum(p_convert) * any_value(mean_revenue) AS expected_revenue,
  sum(uplift) AS incremental_conversions, sum(uplift) * any_value(mean_profit) AS projected_profit, sum(p_convert * discount_value) AS expected_discount
FROM audience a JOIN offers o ON o.id = a.offer_id, means GROUP BY 1"""
_PROJECT_DOUBLES = "expected_conversions expected_revenue incremental_conversions projected_profit expected_discount"


@query("v10_projection", _PROJECT, _PROJECT_DOUBLES, ", ".join([_MATRIX, _FILTERED, _allocation("filtered"), _MEANS]))
def _(w):
    return serving.project(_audience(w), w.offers, serving.conversion_means(w.scored_holdout))


@query("v11_quadrant_mix", """SELECT strategy, quadrant, count(*) AS clients, count(*) / sum(count(*)) OVER (PARTITION BY strategy) AS client_share,
  sum(uplift) * any_value(mean_profit) AS projected_profit FROM audience, means GROUP BY 1, 2""", "client_share projected_profit",
       ", ".join([_MATRIX, _FILTERED, _allocation("filtered"), _MEANS]))
def _(w):
    return serving.quadrant_mix(_audience(w), serving.conversion_means(w.scored_holdout))


_H = f"""h AS (SELECT *, {_HASH} AS score_random, {dynamic(1.0)} AS score_dynamic, {QUADRANT_CASE} AS quadrant FROM scored),
kept AS (SELECT * FROM h WHERE quadrant IN ('persuadable', 'sure_thing', 'lost_cause'))"""


@query("v11_measured_gain", """
SELECT g AS strategy, b AS budget, max(n) AS n, arg_max(gain, n) AS gain, arg_max(conversions, n) AS conversions
FROM curves, unnest([50::BIGINT, 150, 1000]) u(b) WHERE n <= b GROUP BY 1, 2""", "gain conversions", _H + ", " + curve_ctes(" UNION ALL ".join(
    f"SELECT '{s}' AS g, account_id, offer_id, received_time, treatment, converted, net_profit, {c} AS s FROM kept" for s, c in serving.STRATEGY_COLUMNS.items())))
def _(w):
    return serving.measured_gain(w.scored_holdout, _TYPES, _ALLOWED, [50, 150, 1000])


@query("v12_segment_audience", _PROJECT, _PROJECT_DOUBLES, ", ".join([
    _MATRIX, _FILTERED, SPEND_SEGMENTS,
    "in_segment AS (SELECT * FROM filtered WHERE account_id IN (SELECT account_id FROM segments WHERE segment = 'newer'))",
    _allocation("in_segment"), _MEANS]))
def _(w):
    rows = serving.eligible(w.matrix, _TYPES, _ALLOWED, tenure_segments(w), ["newer"])
    return serving.project(_audience(w, rows), w.offers, serving.conversion_means(w.scored_holdout))
