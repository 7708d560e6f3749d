"""Models: exact checks with the cell-mean learner, row checks with boosted trees."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from offertide.functions.storage import shared_folder
from offertide.models import blended, conversion, effect
from offertide.models.fitting import together
from offertide.models.learners import CellMeanLearner
from offertide.models.matrix import FEATURES, linear_matrix, slots, tree_matrix
from offertide.operators import contract, serving
from offertide.plans import history, jobs
from offertide.registry.core import query
from offertide.registry.evaluate import unit
from offertide.registry.serve import _CONTRACT_DOUBLES
from offertide.registry.workspace import CELL_CONDITIONS
from offertide.settings import GRAIN
from offertide.sources import files

_G = "account_id, offer_id, received_time"
_CELL = " || ".join(f"CASE WHEN {c} THEN '1' ELSE '0' END" for c in CELL_CONDITIONS)


def _stage(name: str, rows: str, target: str) -> str:
    return (f"{name} AS MATERIALIZED (SELECT offer_type, cell, avg({target}) AS m FROM {rows} GROUP BY 1, 2), "
            f"{name}_all AS MATERIALIZED (SELECT offer_type, avg({target}) AS a FROM {rows} GROUP BY 1)")


def _value(name: str) -> str:
    return f"""coalesce((SELECT m FROM {name} z WHERE z.offer_type = x.offer_type AND z.cell = x.cell),
  (SELECT a FROM {name}_all z WHERE z.offer_type = x.offer_type))"""


_EFFECT = f"""t_rows AS MATERIALIZED (SELECT *, {_CELL} AS cell FROM train),
t_control AS (SELECT * FROM t_rows WHERE treatment = 0), t_treated AS (SELECT * FROM t_rows WHERE treatment = 1),
{_stage('mu0_cells', 't_control', 'converted')}, {_stage('mu1_cells', 't_treated', 'converted')},
gained AS (SELECT offer_type, cell, converted - {_value('mu0_cells')} AS d FROM t_treated x),
missed AS (SELECT offer_type, cell, {_value('mu1_cells')} - converted AS d FROM t_control x),
{_stage('tt_cells', 'gained', 'd')}, {_stage('tc_cells', 'missed', 'd')},
shares AS (SELECT offer_type, CASE WHEN avg(treatment) > 0 AND avg(treatment) < 1 THEN avg(treatment) ELSE 0.5 END AS p FROM holdout GROUP BY 1),
effects AS MATERIALIZED (SELECT *, p * tau_c + (1 - p) * tau_t AS tau, abs(tau_t - tau_c) AS uncertainty FROM (
  SELECT {_G}, x.offer_type, p, {_value('mu0_cells')} AS mu0, {_value('mu1_cells')} AS mu1, {_value('tt_cells')} AS tau_t, {_value('tc_cells')} AS tau_c
  FROM (SELECT *, {_CELL} AS cell FROM holdout) x JOIN shares s ON s.offer_type = x.offer_type))"""

_M1 = ", ".join(
    f"""coalesce({c}, (SELECT quantile_disc({c}, 0.5) FROM train))::DOUBLE AS {c}_filled, ({c} IS NULL)::INT::DOUBLE AS {c}_missing"""
    for c in FEATURES if c in contract.NULLABLE)


@query("m1_tree_matrix", f"""SELECT {_G}, {_M1}, (dense_rank() OVER (ORDER BY gender) - 1)::DOUBLE AS gender_index,
  (dense_rank() OVER (ORDER BY offer_type) - 1)::DOUBLE AS offer_type_index, hist_spend_total FROM train""",
       "received_time hist_spend_total " + " ".join(f"{c}_filled {c}_missing" for c in FEATURES if c in contract.NULLABLE))
def _(w):
    train, _ = w.split
    wide = tree_matrix(train, FEATURES).transform(train).withColumn("x", vector_to_array("features"))
    wanted = [s for s, owner in slots(FEATURES) if s != owner] + ["hist_spend_total"]
    place = {s: i for i, (s, _) in enumerate(slots(FEATURES))}
    return wide.select(*GRAIN, *[F.col("x")[place[s]].alias(s) for s in wanted])


_PLAIN = [c for c in FEATURES if c not in ("gender", "offer_type")]
_LINEAR = [f"coalesce({c}, 0)::DOUBLE" for c in _PLAIN] + [
    f"(gender = '{g}')::INT::DOUBLE" for g in ("M", "O", "unknown")] + ["(offer_type = 'discount')::INT::DOUBLE"]


@query("m2_linear_matrix", f"""SELECT {_G}, unnest(range(0, {len(_LINEAR)}))::INT AS position, unnest([""" + ", ".join(
    f"CASE WHEN stddev_samp({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () ELSE 0.0 END" for c in _LINEAR)
    + """]) AS value FROM train""", "received_time value")
def _(w):
    train, _ = w.split
    return linear_matrix(train).transform(train).select(*GRAIN, vector_to_array("linear").alias("linear")).select(
        *GRAIN, F.posexplode("linear").alias("position", "value"))


@query("m3_logistic_anchor")
def _(w):
    train, holdout = w.split
    matrix, model = conversion.logistic_anchor(train, w.cfg)
    scored = model.transform(matrix.transform(holdout))
    return scored.select(*GRAIN, "converted", vector_to_array("probability")[1].alias("p_convert"))


@query("m4_conversion_metrics")
def _(w):
    train, holdout = w.split
    return conversion.train_and_measure(train, holdout, w.cfg)[1]


@query("m5_conversion_probability")
def _(w):
    _, holdout = w.split
    return w.conversion.predict(holdout).select(*GRAIN, "p_convert")


@query("m6_fixed_propensity", """SELECT offer_type, CASE WHEN avg(treatment) > 0 AND avg(treatment) < 1 THEN avg(treatment) ELSE 0.5 END AS propensity
FROM holdout GROUP BY 1""", "propensity")
def _(w):
    return effect.fixed_propensity(w.split[1])


@query("m7_effect_stages_fitted", f"SELECT {_G}, tau_t, tau_c FROM effects", "received_time tau_t tau_c", _EFFECT)
def _(w):
    train, holdout = w.split
    model = effect.EffectModel(w.cfg, CellMeanLearner(CELL_CONDITIONS, w.cfg)).fit(train)
    return model.score(holdout).select(*GRAIN, "tau_t", "tau_c")


@query("m7_effect_trees")
def _(w):
    return w.effect.score(w.split[1]).select(*GRAIN, *effect.STAGES, "tau", "uncertainty")


@query("m8_effect", f"SELECT {_G}, offer_type, tau AS uplift FROM effects", "received_time uplift", _EFFECT)
def _(w):
    return w.cell_effect.predict(w.split[1])


@query("m9_effect_stages", f"SELECT {_G}, offer_type, mu0, mu1, tau FROM effects", "received_time mu0 mu1 tau", _EFFECT)
def _(w):
    return w.cell_effect.predict_stages(w.split[1])


@query("m10_effect_uncertainty", f"SELECT {_G}, offer_type, uncertainty FROM effects", "received_time uncertainty", _EFFECT)
def _(w):
    return w.cell_effect.predict_uncertainty(w.split[1])


@query("m11_stage_diagnostics", """SELECT offer_type, avg(mu0) AS mu0_mean, stddev_pop(mu0) AS mu0_std, avg(mu1) AS mu1_mean, stddev_pop(mu1) AS mu1_std,
  avg(mu1) - avg(mu0) AS mu1_minus_mu0, avg(tau) AS tau_mean FROM effects GROUP BY 1""", "mu0_mean mu0_std mu1_mean mu1_std mu1_minus_mu0 tau_mean", _EFFECT)
def _(w):
    return effect.stage_diagnostics(w.cell_effect.score(w.split[1]))


@query("m12_causal_importance")
def _(w):
    found = w.effect.causal_importance(w.split[1])
    return w.spark.createDataFrame(sorted(found.items()), "feature string, importance double")


@query("m13_blend_importance")
def _(w):
    return w.blended.importance(w.split[1])


def _folder(w, name: str) -> str:
    return f"{shared_folder(w.spark)}/{name}-{uuid.uuid4().hex}"


@query("m14_save_and_load", f"SELECT {_G}, 0.0::DOUBLE AS difference FROM holdout", "received_time difference")
def _(w):
    path, holdout = _folder(w, "model"), w.split[1]
    w.blended.save(path, w.spark)
    again = blended.BlendedModel.load(w.spark, w.cfg, path)
    before = w.blended.score(holdout).select(*GRAIN, F.col("score").alias("before"))
    after = again.score(holdout).select(*GRAIN, F.col("score").alias("after"))
    return before.join(after, list(GRAIN)).select(*GRAIN, (F.col("before") - F.col("after")).alias("difference"))


@query("r6_blended_model")
def _(w):
    return w.blended.rank(w.split[1]).select(*GRAIN, "uplift", "p_convert", "uncertainty", "score", "rank")


def _placebo_stage(name: str, rows: str, target: str) -> str:
    return (f"{name} AS MATERIALIZED (SELECT rep, offer_type, cell, avg({target}) AS m FROM {rows} GROUP BY 1, 2, 3), "
            f"{name}_all AS MATERIALIZED (SELECT rep, offer_type, avg({target}) AS a FROM {rows} GROUP BY 1, 2)")


def _placebo_value(name: str) -> str:
    return f"""coalesce((SELECT m FROM {name} z WHERE z.rep = x.rep AND z.offer_type = x.offer_type AND z.cell = x.cell),
  (SELECT a FROM {name}_all z WHERE z.rep = x.rep AND z.offer_type = x.offer_type))"""


_PLACEBO = f"""p_rows AS MATERIALIZED (SELECT a.rep, a.offer_type, a.cell, a.converted, b.treatment FROM
  (SELECT rep, offer_type, {_CELL} AS cell, converted, row_number() OVER (PARTITION BY rep, offer_type ORDER BY {_G}) AS k FROM train, range(0, 20) r(rep)) a
  JOIN (SELECT rep, offer_type, treatment, row_number() OVER (PARTITION BY rep, offer_type ORDER BY
    {unit(42, "'placebo'", "rep", "account_id", "offer_id", "received_time")}, {_G}) AS k FROM train, range(0, 20) r(rep)) b USING (rep, offer_type, k)),
p_control AS (SELECT * FROM p_rows WHERE treatment = 0), p_treated AS (SELECT * FROM p_rows WHERE treatment = 1),
{_placebo_stage('p_mu0', 'p_control', 'converted')}, {_placebo_stage('p_mu1', 'p_treated', 'converted')},
p_gained AS (SELECT rep, offer_type, cell, converted - {_placebo_value('p_mu0')} AS d FROM p_treated x),
p_missed AS (SELECT rep, offer_type, cell, {_placebo_value('p_mu1')} - converted AS d FROM p_control x),
{_placebo_stage('p_tt', 'p_gained', 'd')}, {_placebo_stage('p_tc', 'p_missed', 'd')},
shares AS (SELECT offer_type, avg(treatment) AS p FROM holdout GROUP BY 1),
p_scored AS MATERIALIZED (SELECT rep, treatment, converted, round(p * {_placebo_value('p_tc')} + (1 - p) * {_placebo_value('p_tt')}, 12) AS s
  FROM (SELECT rep, offer_type, {_CELL} AS cell, treatment, converted FROM holdout, range(0, 20) r(rep)) x JOIN shares USING (offer_type)),
p_tied AS (SELECT rep::VARCHAR AS g, s, count(*) AS n, sum(treatment) AS nt, sum(treatment * converted) AS yt, sum((1 - treatment) * converted) AS yc FROM p_scored GROUP BY 1, 2
  UNION ALL SELECT 'best', converted * treatment - converted * (1 - treatment), count(*), sum(treatment), sum(treatment * converted), sum((1 - treatment) * converted) FROM holdout GROUP BY 1, 2),
p_sums AS (SELECT g, sum(n) OVER o AS n, sum(nt) OVER o AS nt, sum(yt) OVER o AS yt, sum(yc) OVER o AS yc FROM p_tied
  WINDOW o AS (PARTITION BY g ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
p_points AS (SELECT g, n, yt - CASE WHEN n > nt THEN yc * (nt / (n - nt)) ELSE 0 END AS q FROM p_sums UNION ALL SELECT DISTINCT g, 0, 0.0 FROM p_tied),
p_areas AS (SELECT g, sum((n - pn) * (q + pq) / 2) - max(n) * arg_max(q, n) / 2 AS area FROM (
  SELECT *, lag(n) OVER o AS pn, lag(q) OVER o AS pq FROM p_points WINDOW o AS (PARTITION BY g ORDER BY n)) GROUP BY 1)"""


@query("r21_placebo_scores", """SELECT g::INT AS replicate, area / (SELECT area FROM p_areas WHERE g = 'best') AS qini
FROM p_areas WHERE g <> 'best'""", "qini", _PLACEBO)
def _(w):
    train, holdout = w.split
    return blended.placebo_scores(train, holdout, w.cfg, CellMeanLearner(CELL_CONDITIONS, w.cfg), w.cfg.placebo_n_permutations)


@query("v5_attach_scores")
def _(w):
    w.split  # noqa: B018 - the shared tables first
    # Fits leave most of the cores idle, so the customers' history is stored beside them.
    parts = together({"grid": lambda: w.serving_grid, "model": lambda: w.blended}, 2)
    return blended.attach_scores(parts["grid"], parts["model"], w.cfg).select(
        "account_id", "offer_id", "offer_type", "uplift", "p_convert", "uncertainty", "score_dynamic", "quadrant")


# Jobs

def _raw_folder(w) -> str:
    """The raw tables of this workspace as JSON Lines."""
    path = _folder(w, "raw")
    w.offers.write.json(f"{path}/{jobs.OFFERS}")
    w.raw_profile.write.json(f"{path}/{jobs.PROFILE}")
    w.raw_events.write.json(f"{path}/{jobs.EVENTS}")
    return path


@query("j1_prepare", f"SELECT {', '.join(contract.COLUMNS)} FROM processed", _CONTRACT_DOUBLES)
def _(w):
    return jobs.prepare(w.spark, _raw_folder(w), _folder(w, "processed"), w.cfg)


@query("j2_train")
def _(w):
    processed = _folder(w, "processed")
    files.write_processed(w.processed, processed)
    model = jobs.train(w.spark, processed, _folder(w, "model"), w.cfg)
    return model.components(w.split[1]).select(*GRAIN, "uplift", "p_convert")


@query("j3_recommend")
def _(w):
    w.split  # noqa: B018 - the shared tables first
    path, out = _folder(w, "model"), _folder(w, "recommended")
    parts = together({"model": lambda: w.blended.save(path, w.spark), "raw": lambda: _raw_folder(w)}, 2)
    jobs.recommend(w.spark, parts["raw"], path, w.cfg, 100, out=out)
    return w.spark.read.csv(out, header=True, schema="rank bigint, account_id string, offer_id string, offer_type string, score double")


@query("j3_staged_history", """SELECT event, count(*) AS events, count(DISTINCT account_id) AS customers, min(time) AS first_time, max(time) AS last_time,
  sum(amount) AS amount, sum(reward) AS reward, true AS nothing_parsed_again FROM log GROUP BY 1""", "first_time last_time amount reward")
def _(w):
    """The log staged in three runs, of which the last finds no new file."""
    raw, store = _folder(w, "raw-days"), _folder(w, "history")
    first = w.raw_events.where("time_since_test_start < 10")
    first.write.json(f"{raw}/early")

    def parsed(paths):
        return files.parse_events(files.read_events(w.spark, paths))

    history.refresh(w.spark, raw, store, parsed)
    w.raw_events.where("NOT coalesce(time_since_test_start < 10, false)").write.json(f"{raw}/late")
    history.refresh(w.spark, raw, store, parsed)
    again = history.refresh(w.spark, raw, store, parsed)
    return history.staged(w.spark, store, files.FLAT_SCHEMA).groupBy("event").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("account_id").alias("customers"), F.min("time").alias("first_time"),
        F.max("time").alias("last_time"), F.sum("amount").alias("amount"), F.sum("reward").alias("reward"),
        F.lit(again == 0).alias("nothing_parsed_again"))


@query("s6_write_recommendations", """SELECT row_number() OVER (ORDER BY s DESC, account_id, offer_id) AS rank, account_id, offer_id, offer_type, s AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY s DESC, offer_id) AS k FROM (
    SELECT account_id, offer_id, offer_type, round(uplift, 4) AS s FROM scored)) WHERE k = 1 QUALIFY rank <= 50""", "score")
def _(w):
    rows = w.scored.selectExpr("account_id", "offer_id", "offer_type", "round(uplift, 4) AS score")
    out = _folder(w, "recommended")
    files.write_recommendations(serving.recommend(rows, 50), out)
    return w.spark.read.csv(out, header=True, schema="rank bigint, account_id string, offer_id string, offer_type string, score double")


@query("j4_publish", """
SELECT (SELECT max(time) FROM log) AS decision_time, coalesce(avg(net_profit) FILTER (treatment = 1 AND converted = 1), 0.0) AS mean_profit,
  coalesce(avg(conversion_value) FILTER (treatment = 1 AND converted = 1), 0.0) AS mean_revenue, (SELECT count(*) FROM profile) AS n_clients,
  (SELECT count(*) FROM profile) * (SELECT count(*) FROM active) AS n_rows, count(*) AS n_holdout_rows, 42 AS seed, 1000 AS default_budget,
  0.0::DOUBLE AS temperature_default, 1.0::DOUBLE AS temperature_max FROM holdout""",
       "decision_time mean_profit mean_revenue temperature_default temperature_max")
def _(w):
    w.split  # noqa: B018 - the shared tables first
    model, processed = _folder(w, "model"), _folder(w, "processed")
    parts = together({"model": lambda: w.blended.save(model, w.spark), "raw": lambda: _raw_folder(w),
                      "processed": lambda: files.write_processed(w.processed, processed)}, 3)
    return jobs.publish(w.spark, parts["raw"], processed, model, _folder(w, "published"), w.cfg)["metadata"]


@query("s7_write_scored_tables", """SELECT 'matrix' AS name, (SELECT count(*) FROM profile) * (SELECT count(*) FROM active) AS rows
UNION ALL SELECT 'holdout', count(*) FROM holdout UNION ALL SELECT 'offers', count(*) FROM offers UNION ALL SELECT 'metadata', 1""")
def _(w):
    out = _folder(w, "published")
    tables = {"matrix": w.matrix, "holdout": w.scored_holdout, "offers": w.offers,
              "metadata": serving.conversion_means(w.scored_holdout)}
    files.write_scored_tables(tables, out)
    parts = [w.spark.read.parquet(f"{out}/{n}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows")
             for n in tables]
    out_rows = parts[0]
    for p in parts[1:]:
        out_rows = out_rows.unionByName(p)
    return out_rows
