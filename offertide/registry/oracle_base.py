"""Shared CTEs of the SQL oracles: the adapter, the reference joins and the processed table."""

from __future__ import annotations

from offertide.functions.numbers import OFF_HALF
from offertide.registry.workspace import FORMULA_SCORES

_SCORES = ", ".join(f"{sql} AS {name}" for name, sql in FORMULA_SCORES.items())

BASE = """
WITH offers AS MATERIALIZED (
  SELECT 'o' || p_partkey AS id,
    CASE WHEN p_partkey % 5 < 2 THEN 'bogo' WHEN p_partkey % 5 < 4 THEN 'discount' ELSE 'informational' END AS offer_type,
    CASE WHEN p_partkey % 5 = 4 THEN 0.0::DOUBLE ELSE (10 + 5 * (p_partkey % 4))::DOUBLE END AS min_value,
    CASE WHEN p_partkey % 5 = 4 THEN 0.0::DOUBLE ELSE (2 + p_partkey % 4)::DOUBLE END AS discount_value,
    (3 + p_partkey % 8)::DOUBLE AS duration,
    list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'web' END, 'email',
      CASE WHEN p_partkey % 3 <> 0 THEN 'mobile' END, CASE WHEN p_partkey % 4 = 1 THEN 'social' END],
      lambda c: c IS NOT NULL) AS channels
  FROM part
),
raw_profile AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id,
    CASE WHEN c_custkey % 8 = 0 THEN 118 ELSE CAST(18 + c_custkey % 70 AS INT) END AS age,
    CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'M' WHEN c_custkey % 3 = 1 THEN 'F' ELSE 'O' END AS gender,
    CASE WHEN c_custkey % 8 <> 0 THEN c_acctbal END AS credit_card_limit,
    strftime(DATE '2024-01-01' - CAST(c_custkey % 1500 AS INT), '%Y%m%d') AS registered_on
  FROM customer
),
profile AS MATERIALIZED (
  SELECT id AS account_id, CASE WHEN age <> 118 THEN age END AS age, coalesce(gender, 'unknown') AS gender,
    credit_card_limit, CASE WHEN age = 118 THEN 1 ELSE 0 END AS identity_missing,
    CAST(date_diff('day', strptime(registered_on, '%Y%m%d')::DATE, DATE '2024-01-01') AS INT) AS tenure_days
  FROM raw_profile
),
source AS (
  SELECT CAST(user_id AS VARCHAR) AS account_id, event_type,
    CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS DOUBLE) / 86400000000.0::DOUBLE AS t,
    'o' || CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS ref, value AS v
  FROM events
),
log AS MATERIALIZED (
  SELECT DISTINCT account_id, 'offer received' AS event, CAST(floor(t / 5) * 5 AS DOUBLE) AS time, ref AS offer_ref,
    NULL::DOUBLE AS amount, NULL::DOUBLE AS reward FROM source WHERE event_type = 'signup'
  UNION ALL SELECT account_id, 'offer viewed', t, ref, NULL, NULL FROM source WHERE event_type = 'view'
  UNION ALL SELECT account_id, 'offer completed', t, ref, NULL, v FROM source WHERE event_type = 'click'
  UNION ALL SELECT account_id, 'transaction', t, NULL, v, NULL FROM source WHERE event_type = 'purchase'
  UNION ALL SELECT account_id, event_type, t, NULL, NULL, NULL FROM source
    WHERE coalesce(event_type NOT IN ('signup', 'view', 'click', 'purchase'), true)
),
receipts AS (SELECT account_id, offer_ref AS offer_id, time AS received_time FROM log WHERE event = 'offer received'),
active AS MATERIALIZED (SELECT * FROM offers WHERE id IN (SELECT offer_id FROM receipts)),
views AS (SELECT account_id, offer_ref AS offer_id, time AS view_time FROM log WHERE event = 'offer viewed'),
done AS (SELECT account_id, offer_ref AS offer_id, time AS completed_time FROM log WHERE event = 'offer completed'),
txns AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY account_id, time, amount) AS txn_id, account_id, time AS txn_time, amount AS txn_amount
  FROM log WHERE event = 'transaction'),
validity AS MATERIALIZED (
  SELECT r.*, o.duration, o.min_value, r.received_time + o.duration AS valid_until
  FROM receipts r LEFT JOIN offers o ON o.id = r.offer_id
),
view_owner AS (
  SELECT b.account_id, b.offer_id, b.received_time, v.view_time,
    row_number() OVER (PARTITION BY b.account_id, b.offer_id, v.view_time ORDER BY b.received_time, b.offer_id) AS k
  FROM validity b JOIN views v ON v.account_id = b.account_id AND v.offer_id = b.offer_id
    AND v.view_time BETWEEN b.received_time AND b.valid_until
),
owned_views AS MATERIALIZED (
  SELECT account_id, offer_id, received_time, min(view_time) AS view_time FROM view_owner WHERE k = 1 GROUP BY ALL),
candidates AS MATERIALIZED (
  SELECT b.account_id, b.offer_id, b.received_time, t.txn_id, t.txn_time, t.txn_amount
  FROM validity b JOIN txns t ON t.account_id = b.account_id
    AND t.txn_time BETWEEN b.received_time AND b.valid_until AND t.txn_amount >= b.min_value
),
owned AS MATERIALIZED (
  SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY received_time, offer_id) AS k FROM candidates)
  WHERE k = 1
),
firsts AS (
  SELECT account_id, offer_id, received_time, txn_time, txn_amount FROM (
    SELECT *, row_number() OVER (PARTITION BY account_id, offer_id, received_time ORDER BY txn_time, txn_amount) AS f FROM owned)
  WHERE f = 1
),
attributed AS MATERIALIZED (
  SELECT b.account_id, b.offer_id, b.received_time, b.valid_until, v.view_time,
    CAST(CASE WHEN f.txn_time IS NULL THEN 0 ELSE 1 END AS BIGINT) AS assigned_txn_count,
    coalesce(f.txn_amount, 0.0) AS assigned_txn_amount_sum, f.txn_time AS first_assigned_txn_time
  FROM validity b
  LEFT JOIN owned_views v USING (account_id, offer_id, received_time)
  LEFT JOIN firsts f USING (account_id, offer_id, received_time)
),
labelled AS MATERIALIZED (
  SELECT *, CASE WHEN assigned_txn_count > 0 THEN 1 ELSE 0 END AS converted,
    CASE WHEN assigned_txn_count > 0 THEN assigned_txn_amount_sum ELSE 0.0 END AS conversion_value
  FROM attributed
),
recurrent AS MATERIALIZED (
  SELECT a.*, CASE WHEN a.converted = 1 AND EXISTS (
    SELECT 1 FROM labelled b WHERE b.account_id = a.account_id AND b.converted = 1
      AND NOT (b.offer_id = a.offer_id AND b.received_time = a.received_time)
      AND b.first_assigned_txn_time > a.first_assigned_txn_time
      AND b.first_assigned_txn_time <= a.first_assigned_txn_time + 7) THEN 1 ELSE 0 END AS is_recurrent
  FROM labelled a
),
f_purchases AS MATERIALIZED (
  SELECT r.account_id, r.offer_id, r.received_time,
    coalesce(sum(t.txn_amount), 0.0) AS hist_spend_total, CAST(count(t.txn_time) AS INT) AS hist_txn_count,
    coalesce(avg(t.txn_amount), 0.0) AS hist_avg_ticket, coalesce(stddev_samp(t.txn_amount), 0.0) AS hist_spend_std,
    r.received_time - max(t.txn_time) AS hist_recency_days,
    CASE WHEN r.received_time > 0 THEN count(t.txn_time) / r.received_time ELSE 0.0 END AS hist_frequency,
    coalesce(avg(t.txn_amount) FILTER (t.txn_time >= r.received_time / 2), 0.0)
      - coalesce(avg(t.txn_amount) FILTER (t.txn_time < r.received_time / 2), 0.0) AS hist_spend_trend
  FROM receipts r LEFT JOIN txns t ON t.account_id = r.account_id AND t.txn_time < r.received_time
  GROUP BY r.account_id, r.offer_id, r.received_time
),
f_counts AS (
  SELECT r.account_id, r.offer_id, r.received_time,
    CAST(count(*) FILTER (e.event = 'offer received') AS INT) AS hist_offers_received,
    CAST(count(*) FILTER (e.event = 'offer viewed') AS INT) AS hist_offers_viewed,
    CAST(count(*) FILTER (e.event = 'offer completed') AS INT) AS hist_offers_completed,
    CAST(count(*) FILTER (e.event = 'offer received' AND o.offer_type = 'bogo') AS INT) AS hist_offers_received_bogo,
    CAST(count(*) FILTER (e.event = 'offer received' AND o.offer_type = 'discount') AS INT) AS hist_offers_received_discount,
    CAST(count(*) FILTER (e.event = 'offer received' AND o.offer_type = 'informational') AS INT) AS hist_offers_received_info,
    count(*) FILTER (e.event = 'offer completed' AND o.offer_type = 'bogo') AS done_bogo,
    count(*) FILTER (e.event = 'offer completed' AND o.offer_type = 'discount') AS done_discount
  FROM receipts r LEFT JOIN log e ON e.account_id = r.account_id AND e.event <> 'transaction' AND e.time < r.received_time
  LEFT JOIN offers o ON o.id = e.offer_ref
  GROUP BY r.account_id, r.offer_id, r.received_time
),
f_responses AS MATERIALIZED (
  SELECT account_id, offer_id, received_time, hist_offers_received, hist_offers_viewed, hist_offers_completed,
    hist_offers_received_bogo, hist_offers_received_discount, hist_offers_received_info,
    CASE WHEN hist_offers_received > 0 THEN hist_offers_viewed / hist_offers_received ELSE 0.0::DOUBLE END AS hist_view_rate,
    CASE WHEN hist_offers_received_bogo > 0 THEN done_bogo / hist_offers_received_bogo ELSE 0.0::DOUBLE END AS hist_conv_rate_bogo,
    CASE WHEN hist_offers_received_discount > 0 THEN done_discount / hist_offers_received_discount ELSE 0.0::DOUBLE END AS hist_conv_rate_discount
  FROM f_counts
),
finished AS MATERIALIZED (
  SELECT d.account_id, d.offer_id, d.completed_time, max(v.view_time) AS last_view
  FROM (SELECT DISTINCT * FROM done) d
  LEFT JOIN views v ON v.account_id = d.account_id AND v.offer_id = d.offer_id AND v.view_time <= d.completed_time
  GROUP BY ALL
),
f_finished AS MATERIALIZED (
  SELECT r.account_id, r.offer_id, r.received_time,
    coalesce(max(CASE WHEN f.completed_time IS NOT NULL AND f.last_view IS NULL THEN 1 ELSE 0 END), 0) AS hist_completed_unseen_flag,
    avg(f.completed_time - f.last_view) AS hist_time_view_to_conv
  FROM receipts r LEFT JOIN finished f ON f.account_id = r.account_id AND f.completed_time < r.received_time
  GROUP BY r.account_id, r.offer_id, r.received_time
),
f_terms AS MATERIALIZED (
  SELECT r.account_id, r.offer_id, r.received_time, o.discount_value, o.min_value, o.duration,
    CAST(len(o.channels) AS INT) AS n_channels, CAST(list_contains(o.channels, 'web') AS INT) AS channel_web,
    CAST(list_contains(o.channels, 'email') AS INT) AS channel_email, CAST(list_contains(o.channels, 'mobile') AS INT) AS channel_mobile,
    CAST(list_contains(o.channels, 'social') AS INT) AS channel_social,
    CASE WHEN o.min_value > 0 THEN o.discount_value / o.min_value ELSE 0.0 END AS discount_to_minvalue_ratio
  FROM receipts r LEFT JOIN offers o ON o.id = r.offer_id
),
f_active AS MATERIALIZED (
  SELECT r.account_id, r.offer_id, r.received_time, CAST(count(b.account_id) AS INT) AS n_concurrent_offers
  FROM receipts r LEFT JOIN validity b ON b.account_id = r.account_id
    AND r.received_time BETWEEN b.received_time AND b.valid_until
    AND NOT (b.offer_id = r.offer_id AND b.received_time = r.received_time)
  GROUP BY r.account_id, r.offer_id, r.received_time
),
waves AS (SELECT received_time, CAST(dense_rank() OVER (ORDER BY received_time) - 1 AS INT) AS campaign_wave
  FROM (SELECT DISTINCT received_time FROM receipts)),
processed AS MATERIALIZED (
  SELECT a.account_id, a.offer_id, o.offer_type, a.received_time, w.campaign_wave,
    CASE WHEN a.view_time IS NULL THEN 0 ELSE 1 END AS treatment, a.converted, a.conversion_value,
    CASE WHEN a.converted = 1 AND o.offer_type <> 'informational' THEN o.discount_value ELSE 0.0 END AS reward_cost,
    a.is_recurrent, p.age, p.gender, p.credit_card_limit, p.identity_missing, p.tenure_days,
    f1.* EXCLUDE (account_id, offer_id, received_time), f2.* EXCLUDE (account_id, offer_id, received_time),
    f3.* EXCLUDE (account_id, offer_id, received_time), f5.* EXCLUDE (account_id, offer_id, received_time),
    f6.n_concurrent_offers, a.valid_until, a.view_time, a.assigned_txn_count, a.assigned_txn_amount_sum, a.first_assigned_txn_time
  FROM recurrent a
  JOIN f_purchases f1 USING (account_id, offer_id, received_time)
  JOIN f_responses f2 USING (account_id, offer_id, received_time)
  JOIN f_finished f3 USING (account_id, offer_id, received_time)
  JOIN f_terms f5 USING (account_id, offer_id, received_time)
  JOIN f_active f6 USING (account_id, offer_id, received_time)
  LEFT JOIN offers o ON o.id = a.offer_id
  LEFT JOIN profile p USING (account_id)
  LEFT JOIN waves w USING (received_time)
),
holdout AS (SELECT *, conversion_value - reward_cost AS net_profit FROM processed
  WHERE campaign_wave >= 4 AND offer_type IN ('bogo', 'discount')),
train AS (SELECT * FROM processed WHERE campaign_wave < 4 AND offer_type IN ('bogo', 'discount')),
scored AS MATERIALIZED (SELECT *, """ + _SCORES + """ FROM holdout)
"""


def half_safe_round(sql: str) -> str:
    return f"round({sql} + {OFF_HALF!r}, 6) + 0.0"


def oracle(body: str, doubles: str = "", extra: str = "") -> str:
    """`body` over the shared CTEs, with the named double columns rounded to 6 digits."""
    text = body
    if doubles:
        parts = ", ".join(f"{half_safe_round(c)} AS {c}" for c in doubles.split())
        text = f"SELECT * REPLACE ({parts}) FROM ({body}) AS answer"
    more = f", {extra}" if extra else ""
    return BASE + more + "\n" + text
