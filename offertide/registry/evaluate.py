"""Scores, rankings, gain curves, uplift metrics and quadrants on formula scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from offertide.operators import gain, quadrant, ranking, uplift_metrics
from offertide.registry.core import query
from offertide.settings import GRAIN

_G = "account_id, offer_id, received_time"
_KEYS = f"{_G}"


def unit(seed: int, *parts: str) -> str:
    """The keyed uniform draw in DuckDB."""
    text = " || '|' || ".join([f"'{seed}'", *parts])
    return f"((('0x' || substr(md5({text}), 1, 13))::UBIGINT + 0.5) / 4503599627370496.0)"


def dynamic(gamma: float) -> str:
    weight = f"power(uncertainty / (max(uncertainty) OVER () + 1e-9), {gamma})"

    def scale(c: str) -> str:
        return f"(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 1e-9))"

    return f"((1 - {weight}) * {scale('uplift')} + {weight} * {scale('p_convert')})"


def ranking_sql(score: str, table: str = "scored") -> str:
    return f"""SELECT {_G}, row_number() OVER (ORDER BY s DESC, {_G}) AS rank
FROM (SELECT *, {score} AS s FROM {table})"""


def _only_rank(df):
    return df.select(*GRAIN, "rank")


@query("r1_uplift_ranking", ranking_sql("uplift"), "received_time")
def _(w):
    return _only_rank(ranking.uplift_ranking(w.scored.select(*GRAIN, "uplift")))


@query("r2_conversion_ranking", ranking_sql("p_convert"), "received_time")
def _(w):
    return _only_rank(ranking.conversion_ranking(w.scored.select(*GRAIN, "p_convert")))


@query("r3_hybrid_ranking", ranking_sql("uplift + 0.3 * p_convert"), "received_time")
def _(w):
    return _only_rank(ranking.hybrid_ranking(w.scored.select(*GRAIN, "uplift", "p_convert"), 0.3))


@query("r4_min_max", f"""SELECT {_G}, (uplift - min(uplift) OVER ()) / (max(uplift) OVER () - min(uplift) OVER () + 1e-9) AS uplift_scaled,
  (p_convert - min(p_convert) OVER ()) / (max(p_convert) OVER () - min(p_convert) OVER () + 1e-9) AS p_convert_scaled FROM scored""",
       "received_time uplift_scaled p_convert_scaled")
def _(w):
    return ranking.min_max(w.scored, ["uplift", "p_convert"]).select(*GRAIN, "uplift_scaled", "p_convert_scaled")


@query("r5_dynamic_score", f"SELECT {_G}, {dynamic(1.0)} AS score_dynamic FROM scored", "received_time score_dynamic")
def _(w):
    return ranking.add_dynamic_score(w.scored, 1.0).select(*GRAIN, "score_dynamic")


@query("r5_dynamic_ranking", ranking_sql(f"round({dynamic(1.0)}, 9)"), "received_time")
def _(w):
    scored = ranking.add_dynamic_score(w.scored, 1.0, "score")
    return _only_rank(ranking.rank_by(scored.select(*GRAIN, F.round("score", 9).alias("score")), "score"))


@query("r6_blend_score", f"""SELECT 'fixed' AS mode, {_G}, uplift + 0.3 * p_convert AS score FROM scored
UNION ALL SELECT 'dynamic', {_G}, {dynamic(1.0)} FROM scored""", "received_time score")
def _(w):
    parts = [ranking.blend_score(w.scored, w.cfg.but(blend_mode=m)).select(F.lit(m).alias("mode"), *GRAIN, "score")
             for m in ("fixed", "dynamic")]
    return parts[0].unionByName(parts[1])


@query("r7_effective_lambda", """SELECT 'fixed' AS mode, 0.3::DOUBLE AS effective_lambda
UNION ALL SELECT 'dynamic', avg(uncertainty / (m + 1e-9)) FROM scored, (SELECT max(uncertainty) AS m FROM scored)""", "effective_lambda")
def _(w):
    parts = [ranking.effective_lambda(w.scored, w.cfg.but(blend_mode=m)).select(F.lit(m).alias("mode"), "effective_lambda")
             for m in ("fixed", "dynamic")]
    return parts[0].unionByName(parts[1])


def curve_ctes(groups: str, table: str = "scored") -> str:
    """CTE `curves` over `groups`: SELECT g, keys..., treatment, converted, net_profit, s."""
    return f"""long_scores AS ({groups}),
prefix AS (SELECT g, row_number() OVER o AS n, sum(treatment) OVER o AS nt, sum(1 - treatment) OVER o AS nc,
  sum(treatment * converted) OVER o AS ct, sum((1 - treatment) * converted) OVER o AS cc, sum(treatment * converted * net_profit) OVER o AS pt
  FROM long_scores WINDOW o AS (PARTITION BY g ORDER BY s DESC, {_G} ROWS UNBOUNDED PRECEDING)),
raw_curve AS (SELECT g, n, ct - CASE WHEN nc > 0 THEN cc * (nt / nc) ELSE 0 END AS conv, CASE WHEN ct > 0 THEN pt / ct ELSE 0.0 END AS per FROM prefix),
curves AS (SELECT g, n, greatest(max(conv * per) OVER o, 0.0) AS gain, greatest(max(conv) OVER o, 0.0)::DOUBLE AS conversions FROM raw_curve
  WINDOW o AS (PARTITION BY g ORDER BY n ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT DISTINCT g, 0, 0.0, 0.0 FROM long_scores)"""


def strategies_sql(scores: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS g, {_G}, treatment, converted, net_profit, ({sql})::DOUBLE AS s FROM scored" for n, sql in scores.items())


_STRATEGIES = {"uplift": "uplift", "conversion": "p_convert", "blend": "uplift + 0.3 * p_convert"}
_CURVES = curve_ctes(strategies_sql(_STRATEGIES))
_LAMBDAS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0)
_LAMBDA_CURVES = curve_ctes(f"""SELECT l AS g, {_G}, treatment, converted, net_profit, uplift + l * p_convert AS s
  FROM scored, unnest([{', '.join(f'{v}::DOUBLE' for v in _LAMBDAS)}]) u(l)""")
_DECILES = "(SELECT d AS decile, round_even((SELECT count(*) FROM scored) * d / 10, 0)::BIGINT AS n FROM range(0, 11) r(d))"


@query("r8_best_lambda_by_decile", f"""
SELECT decile::INT AS decile, arg_max(g, gain) AS best_lambda, max(gain) AS gain FROM (
  SELECT * FROM curves JOIN {_DECILES} USING (n) WHERE decile > 0 ORDER BY g) GROUP BY 1""", "best_lambda gain", _LAMBDA_CURVES)
def _(w):
    return gain.best_lambda_by_decile(w.scored, _LAMBDAS)


@query("r9_weight_by_budget", f"""
SELECT gamma, row_number() OVER o AS n, avg(weight) OVER o AS mean_weight FROM (""" + " UNION ALL ".join(
    f"SELECT {g}::DOUBLE AS gamma, {_G}, power(uncertainty / (max(uncertainty) OVER () + 1e-9), {g}) AS weight, {dynamic(g)} AS s FROM scored"
    for g in (0.5, 1.0, 2.0)) + f""") WINDOW o AS (PARTITION BY gamma ORDER BY s DESC, {_G} ROWS UNBOUNDED PRECEDING)""", "gamma mean_weight")
def _(w):
    return ranking.weight_by_budget(w.scored, w.cfg.dynamic_gamma_grid)


@query("r10_random_ranking", ranking_sql(unit(42, "'random'", "account_id", "offer_id", "received_time")), "received_time")
def _(w):
    return _only_rank(ranking.random_ranking(w.scored.select(*GRAIN), w.cfg.seed))


@query("r11_softmax_ranking", ranking_sql(
    "(uplift - min(uplift) OVER ()) / (max(uplift) OVER () - min(uplift) OVER () + 1e-9) / 0.1 - ln(-ln("
    + unit(42, "'softmax'", "account_id", "offer_id", "received_time") + "))"), "received_time")
def _(w):
    return _only_rank(ranking.softmax_ranking(w.scored.select(*GRAIN, "uplift"), 0.1, w.cfg.seed, "uplift"))


@query("r11_softmax_cold", ranking_sql("uplift"), "received_time")
def _(w):
    return _only_rank(ranking.softmax_ranking(w.scored.select(*GRAIN, "uplift"), 0.0, w.cfg.seed, "uplift"))


@query("r12_gain_curve", "SELECT n, gain, conversions FROM curves WHERE g = 'uplift'", "gain conversions", _CURVES)
def _(w):
    return gain.gain_curve(w.scored, "uplift")


@query("r13_gain_curves", "SELECT g AS strategy, n, gain, conversions FROM curves", "gain conversions", _CURVES)
def _(w):
    return gain.gain_curves(w.scored, _STRATEGIES)


@query("r14_gain_at_budgets", """
SELECT g AS strategy, b AS budget, max(n) AS n, arg_max(gain, n) AS gain, arg_max(conversions, n) AS conversions
FROM curves, unnest([10, 50, 100, 1000]) u(b0), (SELECT 0), LATERAL (SELECT b0::BIGINT AS b) WHERE n <= b GROUP BY 1, 2""", "gain conversions", _CURVES)
def _(w):
    return gain.at_budgets(gain.gain_curves(w.scored, _STRATEGIES), [10, 50, 100, 1000])


_BOOT = 200
_RESAMPLES = f"""size AS (SELECT count(*) AS total FROM scored),
draws AS (SELECT replicate, floor({unit(42, "'resample'", "replicate", "draw")} * total)::BIGINT + 1 AS place
  FROM size, range(1, {_BOOT + 1}) r(replicate), LATERAL (SELECT unnest(range(0, total)) AS draw)),
placed AS (SELECT g, treatment, converted, net_profit, row_number() OVER (PARTITION BY g ORDER BY s DESC, {_G}) AS place FROM (
  {strategies_sql(_STRATEGIES)})),
b_prefix AS (SELECT g, replicate, row_number() OVER o AS n, sum(treatment) OVER o AS nt, sum(1 - treatment) OVER o AS nc,
  sum(treatment * converted) OVER o AS ct, sum((1 - treatment) * converted) OVER o AS cc, sum(treatment * converted * net_profit) OVER o AS pt
  FROM placed JOIN draws USING (place) WINDOW o AS (PARTITION BY g, replicate ORDER BY place ROWS UNBOUNDED PRECEDING)),
b_raw AS (SELECT g, replicate, n, ct - CASE WHEN nc > 0 THEN cc * (nt / nc) ELSE 0 END AS conv, CASE WHEN ct > 0 THEN pt / ct ELSE 0.0 END AS per FROM b_prefix),
b_curves AS (SELECT g, replicate, n, greatest(max(conv * per) OVER o, 0.0) AS gain, greatest(max(conv) OVER o, 0.0)::DOUBLE AS conversions FROM b_raw
  WINDOW o AS (PARTITION BY g, replicate ORDER BY n ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT g, replicate, 0, 0.0, 0.0 FROM (SELECT DISTINCT g, replicate FROM b_raw))"""


@query("r15_gain_curves_with_bands", """
SELECT c.g AS strategy, c.n, c.gain, c.conversions, b.gain_lo, b.gain_hi, b.conversions_lo, b.conversions_hi FROM curves c
JOIN (SELECT g, n, quantile_cont(gain, 0.025) AS gain_lo, quantile_cont(gain, 0.975) AS gain_hi, quantile_cont(conversions, 0.025) AS conversions_lo,
  quantile_cont(conversions, 0.975) AS conversions_hi FROM b_curves GROUP BY 1, 2) b ON b.g = c.g AND b.n = c.n""",
       "gain conversions gain_lo gain_hi conversions_lo conversions_hi", _CURVES + ", " + _RESAMPLES)
def _(w):
    return gain.gain_curves_with_bands(w.scored, _STRATEGIES, w.cfg, _BOOT)


@query("r16_conversions_by_decile", f"""
SELECT strategy, decile, conversions FROM (
  SELECT g AS strategy, decile::INT AS decile, conversions - lag(conversions) OVER (PARTITION BY g ORDER BY decile) AS conversions
  FROM curves JOIN {_DECILES} USING (n)) WHERE decile > 0""", "conversions", _CURVES)
def _(w):
    return gain.conversions_by_decile(w.scored, _STRATEGIES)


@query("r16_conversions_by_decile_with_bands", f"""
SELECT p.strategy, p.decile, p.conversions, b.conversions_lo, b.conversions_hi FROM (
  SELECT g AS strategy, decile::INT AS decile, conversions - lag(conversions) OVER (PARTITION BY g ORDER BY decile) AS conversions
  FROM curves JOIN {_DECILES} USING (n)) p
JOIN (SELECT g AS strategy, decile, quantile_cont(m, 0.025) AS conversions_lo, quantile_cont(m, 0.975) AS conversions_hi FROM (
  SELECT g, replicate, decile::INT AS decile, conversions - lag(conversions) OVER (PARTITION BY g, replicate ORDER BY decile) AS m
  FROM b_curves JOIN {_DECILES} USING (n)) WHERE decile > 0 GROUP BY 1, 2) b USING (strategy, decile)""",
       "conversions conversions_lo conversions_hi", _CURVES + ", " + _RESAMPLES)
def _(w):
    return gain.conversions_by_decile_with_bands(w.scored, _STRATEGIES, w.cfg, _BOOT)


_QINI = f"""tied AS (SELECT g, s, count(*) AS n, sum(treatment) AS nt, sum(treatment * converted) AS yt, sum((1 - treatment) * converted) AS yc FROM (
  {strategies_sql(_STRATEGIES)}
  UNION ALL SELECT 'perfect qini', {_G}, treatment, converted, net_profit, converted * treatment - converted * (1 - treatment) FROM scored
  UNION ALL SELECT 'perfect uplift', {_G}, treatment, converted, net_profit, 2 * (converted = treatment)::INT + CASE WHEN
    (SELECT count(*) FILTER (converted = 1 AND treatment = 0) > count(*) FILTER (converted = 0 AND treatment = 1) FROM scored) THEN converted ELSE treatment END FROM scored
  ) GROUP BY 1, 2),
cumulated AS (SELECT g, sum(n) OVER o AS n, sum(nt) OVER o AS nt, sum(yt) OVER o AS yt, sum(yc) OVER o AS yc FROM tied
  WINDOW o AS (PARTITION BY g ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
q_points AS (SELECT g, n, yt - CASE WHEN n > nt THEN yc * (nt / (n - nt)) ELSE 0 END AS q,
  (CASE WHEN nt > 0 THEN yt / nt ELSE 0 END - CASE WHEN n > nt THEN yc / (n - nt) ELSE 0 END) * n AS u FROM cumulated
  UNION ALL SELECT DISTINCT g, 0, 0.0, 0.0 FROM tied),
q_areas AS (SELECT g, sum((n - pn) * (q + pq) / 2) AS qa, sum((n - pn) * (u + pu) / 2) AS ua FROM (
  SELECT *, lag(n) OVER o AS pn, lag(q) OVER o AS pq, lag(u) OVER o AS pu FROM q_points WINDOW o AS (PARTITION BY g ORDER BY n)) GROUP BY 1),
q_end AS (SELECT max(n) AS total, arg_max(q, n) AS qe, arg_max(u, n) AS ue FROM q_points WHERE g = 'uplift'),
q_scores AS (SELECT a.g AS strategy, (a.qa - total * qe / 2) / (pq.qa - total * qe / 2) AS qini, (a.ua - total * ue / 2) / (pu.ua - total * ue / 2) AS auuc
  FROM q_areas a, q_end, (SELECT qa FROM q_areas WHERE g = 'perfect qini') pq, (SELECT ua FROM q_areas WHERE g = 'perfect uplift') pu
  WHERE a.g NOT LIKE 'perfect%')"""


@query("r17_qini_auuc", "SELECT * FROM q_scores WHERE strategy = 'uplift'", "qini auuc", _QINI)
def _(w):
    return uplift_metrics.qini_auuc(w.scored, {"uplift": "uplift"})


@query("r18_qini_curves", "SELECT g AS strategy, n::BIGINT AS n_targeted, q::DOUBLE AS gain FROM q_points WHERE g NOT LIKE 'perfect%'", "gain", _QINI)
def _(w):
    return uplift_metrics.qini_curves(w.scored, _STRATEGIES)


@query("r19_metrics_by_strategy", "SELECT strategy, unnest(['qini', 'auuc']) AS metric, unnest([qini, auuc]) AS value FROM q_scores", "value", _QINI)
def _(w):
    return uplift_metrics.metrics_table(w.scored, _STRATEGIES)


@query("r20_shuffle_treatment", f"""
SELECT a.account_id, a.offer_id, a.received_time, a.offer_type, b.treatment FROM
  (SELECT {_G}, offer_type, row_number() OVER (PARTITION BY offer_type ORDER BY {_G}) AS k FROM scored) a
JOIN (SELECT offer_type, treatment, row_number() OVER (PARTITION BY offer_type ORDER BY {unit(42, "'placebo'", "'0'", "account_id", "offer_id", "received_time")}, {_G}) AS k FROM scored) b
  USING (offer_type, k)""", "received_time")
def _(w):
    return uplift_metrics.shuffle_treatment(w.scored.select(*GRAIN, "offer_type", "treatment"), w.cfg.seed).select(*GRAIN, "offer_type", "treatment")


@query("r22_placebo_verdict", """
SELECT 0.1::DOUBLE AS qini_real, quantile_cont(v, 0.95) AS threshold, 0.1 > quantile_cont(v, 0.95) AS passed,
  count(*) FILTER (v >= 0.1) / count(*) AS p_value, avg(v) AS null_mean, stddev_pop(v) AS null_std
FROM (SELECT uplift AS v FROM scored)""", "qini_real threshold p_value null_mean null_std")
def _(w):
    return uplift_metrics.placebo_verdict(0.1, w.scored.selectExpr("uplift AS qini"), w.cfg)


QUADRANT_CASE = """CASE WHEN uplift > 0.012 THEN 'persuadable' WHEN uplift < -0.012 THEN 'sleeping_dog'
  WHEN p_convert >= 0.5 THEN 'sure_thing' ELSE 'lost_cause' END"""
_QUADRANTS = f"quadrants AS (SELECT *, {QUADRANT_CASE} AS quadrant FROM scored)"
_TOP = _QUADRANTS + f""", top_rows AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY p_convert DESC, {_G}) AS rank FROM quadrants) WHERE rank <= 150)"""


@query("q1_quadrants", f"SELECT {_G}, quadrant FROM quadrants", "received_time", _QUADRANTS)
def _(w):
    return quadrant.add_quadrant(w.scored, w.cfg).select(*GRAIN, "quadrant")


@query("q2_quadrant_distribution", """SELECT offer_type, quadrant, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY offer_type) AS share
FROM quadrants GROUP BY 1, 2""", "share", _QUADRANTS)
def _(w):
    return quadrant.quadrant_distribution(quadrant.add_quadrant(w.scored, w.cfg))


def _marked(w):
    """Only what the rankings and the quadrant tables need goes through the stored layout."""
    return quadrant.add_quadrant(w.scored, w.cfg).select(
        *GRAIN, "treatment", "converted", "net_profit", "uplift", "p_convert", "quadrant")


@query("q3_composition_at_budget", """SELECT quadrant, count(*) AS n, count(*) / (SELECT count(*) FROM top_rows) AS share, avg(uplift) AS mean_tau
FROM top_rows GROUP BY 1""", "share mean_tau", _TOP)
def _(w):
    ranked = ranking.conversion_ranking(_marked(w))
    return quadrant.composition_at_budget(ranked, 150)


@query("q4_gain_by_quadrant", """
SELECT quadrant, n, CASE WHEN nc > 0 THEN (ct - cc * nt / nc) * (CASE WHEN ct > 0 THEN pt / ct ELSE 0 END) END AS gain, nc > 0 AS evaluable, mean_tau FROM (
  SELECT quadrant, count(*) AS n, sum(treatment) AS nt, sum(1 - treatment) AS nc, sum(treatment * converted) AS ct, sum((1 - treatment) * converted) AS cc,
    sum(treatment * converted * net_profit) AS pt, avg(uplift) AS mean_tau FROM top_rows GROUP BY 1)""", "gain mean_tau", _TOP)
def _(w):
    ranked = ranking.conversion_ranking(_marked(w))
    return quadrant.gain_by_quadrant(ranked, 150)


@query("q5_left_on_table", f"""
SELECT count(*) AS persuadables, count(*) FILTER (c.rank IS NULL) AS missed, count(*) FILTER (c.rank IS NULL) / count(*) AS missed_share FROM
  (SELECT *, row_number() OVER (ORDER BY uplift DESC, {_G}) AS place FROM quadrants) r
LEFT JOIN top_rows c USING (account_id, offer_id, received_time) WHERE r.place <= 150 AND r.quadrant = 'persuadable'""", "missed_share", _TOP)
def _(w):
    marked = _marked(w)
    return quadrant.left_on_table(ranking.uplift_ranking(marked), ranking.conversion_ranking(marked), 150)
