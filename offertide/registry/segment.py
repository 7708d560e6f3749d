"""Customer segmentation, on given labels where an exact oracle is wanted."""

from __future__ import annotations

from pyspark.sql import functions as F

from offertide.operators import describe, segments
from offertide.registry.core import query
from offertide.registry.describe import PROFILE_DOUBLES, profile_sql

_CLIENTS = """clients AS MATERIALIZED (
  SELECT p.*, coalesce(t.spend, 0.0) AS spend_total, coalesce(t.n, 0) AS txn_count, CASE WHEN t.n > 0 THEN t.spend / t.n ELSE 0.0 END AS avg_ticket,
    offers_viewed / offers_received AS view_rate, conversions / offers_received AS conv_rate, conversion_value - reward_cost AS margin
  FROM (SELECT account_id, max(age) AS age, max(credit_card_limit) AS credit_card_limit, max(tenure_days) AS tenure_days, max(identity_missing) AS identity_missing,
    max(gender) AS gender, count(*) AS offers_received, sum(treatment)::BIGINT AS offers_viewed, sum(converted)::BIGINT AS conversions,
    sum(conversion_value) AS conversion_value, sum(reward_cost) AS reward_cost FROM processed GROUP BY 1) p
  LEFT JOIN (SELECT account_id, sum(txn_amount) AS spend, count(*) AS n FROM txns GROUP BY 1) t USING (account_id))"""
_CLIENT_DOUBLES = "credit_card_limit conversion_value reward_cost spend_total avg_ticket view_rate conv_rate margin"
_SEGMENTS = _CLIENTS + """, segments AS MATERIALIZED (SELECT *, CASE WHEN identity_missing = 1 THEN 'missing identity'
  ELSE 'cluster ' || (account_id::BIGINT % 4) END AS segment FROM clients)"""
_FEATURES = ("age", "credit_card_limit", "tenure_days", "spend_total", "txn_count", "avg_ticket", "view_rate")


def _labels(w):
    return w.clients.where("identity_missing = 0").selectExpr(
        "account_id", "CAST(CAST(account_id AS BIGINT) % 4 AS INT) AS cluster")


def _segments(w):
    return segments.assign_segments(w.clients, _labels(w))


@query("g1_client_features", "SELECT * FROM clients", _CLIENT_DOUBLES, _CLIENTS)
def _(w):
    return w.clients


_LOGGED = {c: f"ln(1 + {c})" if c in segments.LOG_FEATURES else c for c in _FEATURES}


@query("g2_design_matrix", "SELECT account_id, " + ", ".join(
    f"({sql} - avg({sql}) OVER ()) / stddev_pop({sql}) OVER () AS {c}" for c, sql in _LOGGED.items())
    + " FROM clients WHERE identity_missing = 0", " ".join(_FEATURES), _CLIENTS)
def _(w):
    return segments.design_matrix(w.clients, w.cfg).frame


@query("g3_scan_k")
def _(w):
    return segments.scan_k(segments.design_matrix(w.clients, w.cfg), w.cfg)


@query("g4_choose_k", """SELECT arg_max(k, s)::INT AS k FROM (
  SELECT g AS k, avg(view_rate) AS s FROM (SELECT 2 + (account_id::BIGINT % 5) AS g, view_rate FROM clients) GROUP BY 1 ORDER BY 1)""", "", _CLIENTS)
def _(w):
    # Any table with k and silhouette will do: here one derived from the customers.
    scan = w.clients.selectExpr("CAST(2 + CAST(account_id AS BIGINT) % 5 AS INT) AS k", "view_rate").groupBy("k").agg(
        F.avg("view_rate").alias("silhouette"))
    return segments.choose_k(scan)


@query("g5_fit_clusters")
def _(w):
    return segments.fit_clusters(segments.design_matrix(w.clients, w.cfg), 3, w.cfg)[0]


@query("g6_assign_segments", "SELECT account_id, segment FROM segments", "", _SEGMENTS)
def _(w):
    return _segments(w).select("account_id", "segment")


_PROFILE = ("segment_profile AS MATERIALIZED (SELECT segment, count(*) AS clients, count(*) / (SELECT count(*) FROM segments) AS share, "
            + ", ".join(f"avg({c}) AS {c}" for c in segments.PROFILE_MEANS) + " FROM segments GROUP BY 1)")
_PROFILE_DOUBLES = "share " + " ".join(segments.PROFILE_MEANS)


@query("g7_segment_profile", "SELECT * FROM segment_profile", _PROFILE_DOUBLES, _SEGMENTS + ", " + _PROFILE)
def _(w):
    return segments.segment_profile(_segments(w))


_PERSONAS = """personas AS (SELECT segment, clients, share, spend_total, CASE WHEN segment = 'missing identity' THEN 'Incomplete registration' WHEN c = 1 THEN 'Base'
  WHEN k = 1 THEN 'High value' WHEN k = c THEN 'Low ticket' ELSE 'Mid value ' || (k - 1) END AS persona FROM (
  SELECT *, row_number() OVER (PARTITION BY segment = 'missing identity' ORDER BY spend_total DESC, segment) AS k,
    count(*) OVER (PARTITION BY segment = 'missing identity') AS c FROM segment_profile))"""


@query("g8_name_personas", "SELECT segment, persona, clients, share, spend_total FROM personas", "share spend_total", ", ".join([_SEGMENTS, _PROFILE, _PERSONAS]))
def _(w):
    named = segments.name_personas(segments.segment_profile(_segments(w)))
    return named.select("segment", "persona", "clients", "share", "spend_total")


_RESPONSE = """response AS MATERIALIZED (SELECT segment, offer_type, count(*) AS sends, sum(treatment)::BIGINT AS viewed, sum(converted)::BIGINT AS converted,
  sum(p.conversion_value) AS revenue, sum(p.reward_cost) AS cost, sum(treatment) / count(*) AS view_rate, sum(converted) / count(*) AS conversion_rate,
  CASE WHEN sum(treatment) > 0 THEN sum(converted) / sum(treatment) END AS conversion_per_view,
  (sum(p.conversion_value) - sum(p.reward_cost)) / count(*) AS margin_per_send FROM processed p JOIN segments s USING (account_id) GROUP BY 1, 2)"""


@query("g9_segment_response", "SELECT * FROM response", "revenue cost view_rate conversion_rate conversion_per_view margin_per_send", _SEGMENTS + ", " + _RESPONSE)
def _(w):
    return segments.segment_response(w.processed, _segments(w), w.hot)


_Z = (*_FEATURES, "conv_rate")


@query("g10_segment_z_scores", "SELECT segment, " + ", ".join(
    f"CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () END AS {c}" for c in _Z) + " FROM segment_profile",
       " ".join(_Z), _SEGMENTS + ", " + _PROFILE)
def _(w):
    return segments.segment_z_scores(segments.segment_profile(_segments(w)), _Z)


@query("g11_persona_synthesis", """SELECT persona, clients, share, mean_margin, best_offer_type FROM personas JOIN (
  SELECT segment, avg(margin_per_send) AS mean_margin, arg_max(offer_type, margin_per_send) AS best_offer_type FROM response GROUP BY 1) USING (segment)""",
       "share mean_margin", ", ".join([_SEGMENTS, _PROFILE, _PERSONAS, _RESPONSE]))
def _(w):
    marked = _segments(w)
    personas = segments.name_personas(segments.segment_profile(marked))
    return segments.persona_synthesis(personas, segments.segment_response(w.processed, marked, w.hot))


_DESCRIBED = (*_FEATURES, "offers_received", "offers_viewed", "conv_rate")


@query("g12_client_describe", profile_sql("clients", _DESCRIBED), PROFILE_DOUBLES, _CLIENTS)
def _(w):
    return describe.numeric_profile(w.clients, _DESCRIBED, w.cfg)


def _spend_histogram(name: str, sql: str) -> str:
    return f"""SELECT '{name}' AS scale, lo + (b + 0.5) * w AS center, count(*) AS rows FROM (
  SELECT lo, (hi - lo) / 40 AS w, least(floor(({sql} - lo) / ((hi - lo) / 40)), 39) AS b FROM clients,
    (SELECT min({sql}) AS lo, max({sql}) AS hi FROM clients WHERE identity_missing = 0) WHERE identity_missing = 0) GROUP BY lo, w, b"""


@query("g12_spend_histogram", _spend_histogram("raw", "spend_total") + " UNION ALL " + _spend_histogram("log", "ln(1 + spend_total)"),
       "center", _CLIENTS)
def _(w):
    complete = w.clients.where("identity_missing = 0").selectExpr("spend_total AS raw", "ln(1 + spend_total) AS log")
    parts = [describe.numeric_histogram(complete, c, w.cfg.histogram_bins).select(F.lit(c).alias("scale"), "center", "rows")
             for c in ("raw", "log")]
    return parts[0].unionByName(parts[1])


@query("g13_centroids")
def _(w):
    design = segments.design_matrix(w.clients, w.cfg)
    return segments.centroids(segments.fit_clusters(design, 3, w.cfg)[1], design)
