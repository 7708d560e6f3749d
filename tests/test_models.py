import pytest
from pyspark.sql import functions as F

from offertide.models import blended, conversion, effect
from offertide.models.learners import CellMeanLearner
from offertide.operators import clean, uplift_metrics
from offertide.plans import jobs
from offertide.settings import GRAIN, Settings

from planted import planted

CFG = Settings(effect_trees=6, effect_depth=3, conversion_trees=8, conversion_depth=3, conversion_step=0.2,
               effect_step=0.3, tree_min_rows=5, logit_max_iter=60)


@pytest.fixture(scope="module")
def sides(spark):
    train, holdout = clean.temporal_split(clean.paid_types_only(planted(spark, 3000)), CFG)
    return train.cache(), holdout.cache()


@pytest.fixture(scope="module")
def model(sides):
    return blended.BlendedModel(CFG).fit(sides[0])


def test_one_arm_gives_one_half(spark):
    df = spark.createDataFrame([("bogo", 1), ("bogo", 1), ("discount", 1), ("discount", 0), ("discount", 0), ("discount", 1)],
                               "offer_type string, treatment int")
    assert {r[0]: r[1] for r in effect.fixed_propensity(df).collect()} == {"bogo": 0.5, "discount": 0.5}
    skewed = df.unionByName(spark.createDataFrame([("discount", 1)] * 4, df.schema))
    assert {r[0]: r[1] for r in effect.fixed_propensity(skewed).collect()}["discount"] == pytest.approx(0.75)


def test_both_conversion_models_find_the_signal(sides):
    trees, metrics = conversion.train_and_measure(*sides, CFG)
    found = {(r["model"], r["metric"]): r["value"] for r in metrics.collect()}
    assert found["logistic", "auc"] > 0.55 and found["trees", "auc"] > 0.55
    assert sum(trees.importance().values()) == pytest.approx(1.0)


def test_scoring_before_fitting_is_refused(sides):
    with pytest.raises(RuntimeError):
        conversion.ConversionModel(CFG).predict(sides[1])
    with pytest.raises(RuntimeError):
        effect.EffectModel(CFG).predict(sides[1])


def test_scores_keep_every_row_and_ignore_its_order(sides, model):
    holdout = sides[1]
    scored = model.score(holdout)
    assert scored.count() == holdout.count() == scored.select(*GRAIN).distinct().count()
    a = {r[0]: (r[1], r[2]) for r in scored.select("account_id", "uplift", "p_convert").collect()}
    b = {r[0]: (r[1], r[2]) for r in model.score(holdout.repartition(7)).select("account_id", "uplift", "p_convert").collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    assert scored.where("p_convert < 0 OR p_convert > 1 OR uncertainty < 0").count() == 0


def test_stages_add_up(sides, model):
    rows = model.effect.score(sides[1]).join(effect.fixed_propensity(sides[1]), "offer_type")
    off = rows.where("abs(tau - (propensity * tau_c + (1 - propensity) * tau_t)) > 1e-9 OR abs(uncertainty - abs(tau_t - tau_c)) > 1e-9")
    assert off.count() == 0
    diagnostics = effect.stage_diagnostics(model.effect.score(sides[1])).collect()
    assert {r["offer_type"] for r in diagnostics} == {"bogo", "discount"}
    assert all(r["mu1_mean"] > r["mu0_mean"] for r in diagnostics)


def test_sure_things_get_a_small_effect(spark):
    train, holdout = clean.temporal_split(clean.paid_types_only(planted(spark, 1200, sure_things=True)), CFG)
    scored = effect.EffectModel(CFG).fit(train).score(holdout)
    means = {r["sure"]: r["t"] for r in scored.groupBy((F.col("hist_spend_total") > 50).alias("sure")).agg(F.avg("tau").alias("t")).collect()}
    assert abs(means[True]) < 0.25 and means[False] > 0.5


def test_impossible_control_label_makes_mu0_vanish(spark):
    train, _ = clean.temporal_split(clean.paid_types_only(planted(spark, dead_control=True)), CFG)
    rows = effect.stage_diagnostics(effect.EffectModel(CFG).fit(train).score(train)).collect()
    assert all(abs(r["mu0_mean"]) < 1e-9 for r in rows)


def test_missing_arm_is_refused(sides):
    with pytest.raises(ValueError, match="one arm"):
        effect.EffectModel(CFG).fit(sides[0].where("treatment = 1"))


def test_saved_models_score_the_same(spark, sides, model, tmp_path):
    model.save(str(tmp_path / "m"), spark)
    again = blended.BlendedModel.load(spark, CFG.but(blend_lambda=9.0), str(tmp_path / "m"))
    assert again.cfg.blend_lambda == CFG.blend_lambda
    a = {r[0]: r[1] for r in model.score(sides[1]).select("account_id", "score").collect()}
    b = {r[0]: r[1] for r in again.score(sides[1]).select("account_id", "score").collect()}
    assert a == b


def test_cell_means_survive_saving(spark, sides, tmp_path):
    learner = CellMeanLearner(["hist_spend_total > 50", "hist_view_rate > 0.5"], CFG)
    fitted = effect.EffectModel(CFG, learner).fit(sides[0])
    fitted.save(str(tmp_path / "cells"))
    again = effect.EffectModel(CFG, learner).restore(spark, str(tmp_path / "cells"), ["bogo", "discount"])
    a = {r[0]: r[1] for r in fitted.score(sides[1]).select("account_id", "tau").collect()}
    assert a == {r[0]: r[1] for r in again.score(sides[1]).select("account_id", "tau").collect()}


@pytest.mark.parametrize("mode", ["fixed", "dynamic"])
def test_importance_is_a_share(sides, model, mode):
    model.cfg = CFG.but(blend_mode=mode)
    rows = model.importance(sides[1]).collect()
    model.cfg = CFG
    for column in ("uplift", "conversion", "combined"):
        assert sum(r[column] for r in rows) == pytest.approx(1.0) and min(r[column] for r in rows) >= 0
    assert {r["feature"]: r["uplift"] for r in rows}["offer_type"] == 0.0


def test_attached_scores_leave_informational_rows_null(spark, model):
    frame = planted(spark, 60)
    out = blended.attach_scores(frame, model, CFG)
    assert out.count() == 60
    assert out.where("offer_type = 'informational' AND (uplift IS NOT NULL OR quadrant IS NOT NULL)").count() == 0
    assert out.where("offer_type <> 'informational' AND (uplift IS NULL OR quadrant IS NULL OR score_dynamic IS NULL)").count() == 0


def test_real_signal_beats_the_placebo(sides):
    train, holdout = sides
    learner = CellMeanLearner(["hist_spend_total > 50"], CFG)
    null = blended.placebo_scores(train, holdout, CFG, learner, 3)
    assert null.count() == 3 and null.select("qini").distinct().count() > 1
    verdict = uplift_metrics.placebo_verdict(2.0, null, CFG).first()
    assert verdict["passed"] and verdict["p_value"] == 0.0


def test_jobs_end_to_end(spark, make_events, tmp_path):
    import random

    from offertide.settings import BOUGHT, SEEN, SENT
    from offertide.sources.files import OFFER_SCHEMA, PROFILE_SCHEMA

    rng = random.Random(9)
    offers = spark.createDataFrame([(f"o{k}", ("bogo", "discount", "informational")[k % 3], 0.0 if k % 3 == 2 else 5.0,
                                     0.0 if k % 3 == 2 else 2.0, 4.0, ["web", "email"]) for k in range(6)], OFFER_SCHEMA)
    profile = spark.createDataFrame([(f"c{i}", 118 if i % 8 == 0 else 20 + i % 40, None if i % 8 == 0 else "F", None if i % 8 == 0 else 9.0, "20180101")
                                     for i in range(80)], PROFILE_SCHEMA)
    log = []
    for i in range(80):
        for wave in range(6):
            offer = f"o{rng.randrange(6)}"
            log.append((f"c{i}", SENT, 5.0 * wave, offer))
            if rng.random() < 0.6:
                log.append((f"c{i}", SEEN, 5.0 * wave + 1, offer))
            if rng.random() < 0.6:
                log.append((f"c{i}", BOUGHT, 5.0 * wave + 2 + rng.random(), None, round(rng.uniform(3, 30), 2)))
    raw = str(tmp_path / "raw")
    offers.write.json(f"{raw}/offers")
    profile.write.json(f"{raw}/profile")
    make_events(*log).selectExpr(
        "account_id", "event", "time AS time_since_test_start",
        "named_struct('offer id', offer_ref, 'offer_id', CAST(NULL AS STRING), 'amount', amount, 'reward', reward) AS value",
    ).write.json(f"{raw}/events")

    processed = jobs.prepare(spark, raw, str(tmp_path / "processed"), CFG)
    assert processed.count() == 480
    quick = CFG.but(effect_trees=2, conversion_trees=2, effect_depth=2, conversion_depth=2)
    jobs.train(spark, str(tmp_path / "processed"), str(tmp_path / "model"), quick)
    chosen = jobs.recommend(spark, raw, str(tmp_path / "model"), CFG, 20, out=str(tmp_path / "out"))
    assert chosen.count() == 20 and chosen.select("account_id").distinct().count() == 20
    assert chosen.join(offers.where("offer_type = 'informational'"), chosen["offer_id"] == offers["id"]).count() == 0
    tables = jobs.publish(spark, raw, str(tmp_path / "processed"), str(tmp_path / "model"), str(tmp_path / "site"), CFG)
    meta = tables["metadata"].first()
    assert (meta["n_clients"], meta["n_rows"]) == (80, 480) and meta["mean_profit"] > 0
    assert tables["holdout"].count() == meta["n_holdout_rows"]


def test_placebo_replicates_share_the_rows_in_key_order(sides, monkeypatch):
    train, holdout = sides
    made = []
    real = uplift_metrics.treatment_slots
    monkeypatch.setattr(uplift_metrics, "treatment_slots", lambda df: made.append(df.columns) or real(df))
    learner = CellMeanLearner(("hist_txn_count >= 4",), CFG)
    blended.placebo_scores(train, holdout, CFG, learner, 2)
    assert len(made) == 1 and "campaign_wave" not in made[0]
