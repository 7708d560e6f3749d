"""Closed-form checks of rankings, gain curves, uplift metrics and quadrants."""

import math
import random

import pytest
from pyspark.sql import functions as F

from offertide.operators import gain, quadrant, ranking, serving, uplift_metrics
from offertide.operators.clean import temporal_split
from offertide.operators.quality import temporal_order


@pytest.fixture
def make_holdout(spark):
    """(treatment, converted, value, cost, score) in rank order."""

    def build(*rows):
        data = [(f"a{i:04d}", "o1", 0.0, int(t), int(c), float(v), float(v - k), float(s))
                for i, (t, c, v, k, s) in enumerate(rows)]
        return spark.createDataFrame(
            data, "account_id string, offer_id string, received_time double, treatment int, converted int,"
                  " conversion_value double, net_profit double, s double")

    return build


def _curve(df):
    rows = sorted(gain.gain_curve(df, "s").collect(), key=lambda r: r["n"])
    return [round(r["gain"], 9) for r in rows], [round(r["conversions"], 9) for r in rows]


def test_envelope_never_falls(make_holdout):
    gains, _ = _curve(make_holdout((1, 1, 50, 10, 2), (0, 1, 50, 10, 1)))
    assert gains == [0, 40, 40]


def test_control_scales_to_the_treated(make_holdout):
    _, conversions = _curve(make_holdout((0, 1, 10, 0, 3), (1, 1, 10, 0, 2), (1, 1, 10, 0, 1)))
    # Two converted treated rows against one converted control scaled by 2 / 1.
    assert conversions == [0, 0, 0, 0]


def _brute_curve(rows):
    ct = cc = nt = nc = 0
    pt, best_g, best_c = 0.0, 0.0, 0.0
    out = [(0.0, 0.0)]
    for t, c, v, k, _ in rows:
        nt, nc, ct, cc = nt + t, nc + 1 - t, ct + t * c, cc + (1 - t) * c
        pt += (v - k) * t * c
        conv = ct - (cc * nt / nc if nc else 0)
        best_g, best_c = max(best_g, conv * (pt / ct if ct else 0)), max(best_c, conv)
        out.append((best_g, best_c))
    return out


def test_random_curve_equals_a_loop(make_holdout):
    rng = random.Random(1)
    rows = [(rng.randrange(2), rng.randrange(2), round(rng.uniform(5, 40), 2), 3, 1000 - i) for i in range(300)]
    gains, conversions = _curve(make_holdout(*rows))
    want = _brute_curve(rows)
    assert gains == pytest.approx([w[0] for w in want]) and conversions == pytest.approx([w[1] for w in want])


def test_budget_reads_the_last_point_not_above_it(make_holdout):
    curves = gain.gain_curves(make_holdout((1, 1, 50, 10, 2), (0, 0, 0, 0, 1)), {"a": "s"})
    got = {r["budget"]: r["n"] for r in gain.at_budgets(curves, [0, 1, 99]).collect()}
    assert got == {0: 0, 1: 1, 99: 2}


def test_bands_contain_the_point(make_holdout, cfg):
    rng = random.Random(2)
    rows = [(int(rng.random() < 0.6), int(rng.random() < 0.5), 20.0, 5.0, 1000 - i) for i in range(120)]
    df = make_holdout(*rows)
    out = gain.gain_curves_with_bands(df, {"a": "s"}, cfg, 60).where("n IN (60, 120)").collect()
    assert len(out) == 2 and all(r["gain_lo"] <= r["gain"] <= r["gain_hi"] for r in out)
    deciles = gain.conversions_by_decile_with_bands(df, {"a": "s"}, cfg, 20)
    assert deciles.count() == 10 and set(deciles.columns) >= {"conversions_lo", "conversions_hi"}
    assert gain.gain_curves_with_bands(df, {"a": "s"}, cfg, 5, points=[10, 20]).count() == 2


def test_bands_at_deciles_equal_those_of_whole_curves(make_holdout, cfg, monkeypatch):
    rng = random.Random(4)
    df = make_holdout(*[(int(rng.random() < 0.6), int(rng.random() < 0.5), 20.0, 5.0, 1000 - i) for i in range(35)])
    known = {}
    curves = gain._curves
    monkeypatch.setattr(gain, "_curves", lambda rows, group, *more: known.setdefault(len(group), curves(rows, group, *more)))
    got = gain.conversions_by_decile_with_bands(df, {"a": "s"}, cfg, 20).orderBy("decile").collect()
    at_cuts = {r["n"] for r in known[2].collect()}
    assert at_cuts == {round(35 * d / 10) for d in range(11)}
    whole = gain._resampled_curves(df, {"a": "s"}, cfg, 20, lambda n: None)
    monkeypatch.setattr(gain, "_resampled_curves", lambda *a: whole)
    want = gain.conversions_by_decile_with_bands(df, {"a": "s"}, cfg, 20).orderBy("decile").collect()
    assert got == want


@pytest.fixture
def scores(spark):
    return spark.createDataFrame(
        [("a", "o1", 0.0, 0.2, 0.1, 0.0), ("b", "o1", 0.0, 0.1, 0.9, 0.5), ("c", "o1", 0.0, 0.3, 0.5, 1.0)],
        "account_id string, offer_id string, received_time double, uplift double, p_convert double, uncertainty double")


def _order(ranked):
    return [r["account_id"] for r in sorted(ranked.collect(), key=lambda r: r["rank"])]


def test_blend_limits(scores):
    assert _order(ranking.hybrid_ranking(scores, 0.0)) == _order(ranking.uplift_ranking(scores)) == ["c", "a", "b"]
    assert _order(ranking.hybrid_ranking(scores, 100.0)) == _order(ranking.conversion_ranking(scores)) == ["b", "c", "a"]
    rows = {r["account_id"]: r["score_dynamic"] for r in ranking.add_dynamic_score(scores, 1.0).collect()}
    # No uncertainty: scaled uplift alone. Full uncertainty: scaled conversion alone.
    assert rows["a"] == pytest.approx(0.5, abs=1e-6) and rows["c"] == pytest.approx(0.5, abs=1e-6)


def test_softmax_is_cold_at_zero_and_reproducible(scores):
    assert _order(ranking.softmax_ranking(scores, 0.0, 1, "uplift")) == ["c", "a", "b"]
    assert _order(ranking.softmax_ranking(scores, 5.0, 1, "uplift")) == _order(ranking.softmax_ranking(scores, 5.0, 1, "uplift"))
    seen = {tuple(_order(ranking.softmax_ranking(scores, 5.0, s, "uplift"))) for s in range(6)}
    assert len(seen) > 1


def _population(spark, seed=0, n=3000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        effect = rng.uniform(-0.2, 0.6)
        t = int(rng.random() < 0.6)
        rows.append((f"a{i:05d}", "o1", 0.0, t, int(rng.random() < 0.3 + t * effect), effect, rng.random()))
    return spark.createDataFrame(
        rows, "account_id string, offer_id string, received_time double, treatment int, converted int, effect double, noise double")


def test_qini_orders_perfect_true_and_random(spark):
    df = _population(spark)
    out = {r["strategy"]: r for r in uplift_metrics.qini_auuc(df, {
        "perfect": "converted * treatment - converted * (1 - treatment)", "true": "effect", "random": "noise", "flat": "0"}).collect()}
    assert out["perfect"]["qini"] == pytest.approx(1.0)
    assert out["true"]["qini"] > 0.05 and out["true"]["auuc"] > 0.05
    assert abs(out["random"]["qini"]) < 0.05 and out["flat"]["qini"] == pytest.approx(0.0, abs=1e-9)


def test_qini_by_hand(make_holdout):
    # Points (0,0), (1,1), (2,0), (3,1), (4,1): ties on the last two rows collapse to (4, 1).
    df = make_holdout((1, 1, 1, 0, 3), (0, 1, 1, 0, 2), (1, 1, 1, 0, 1), (0, 0, 1, 0, 1))
    points = {r["n_targeted"]: r["gain"] for r in uplift_metrics.qini_curves(df, {"a": "s"}).collect()}
    assert points == {0: 0.0, 1: 1.0, 2: 0.0, 4: 1.0}
    model = 0.5 + 0.5 + 2 * 0.5
    perfect = 2 * 2 / 2 + (2 + 2) / 2 + (2 + 1) / 2  # (0, 0), (2, 2), (3, 2), (4, 1)
    base = 4 * 1 / 2
    got = uplift_metrics.qini_auuc(df, {"a": "s"}).first()["qini"]
    assert got == pytest.approx((model - base) / (perfect - base))


def test_shuffle_keeps_arm_sizes(spark):
    df = _population(spark, n=400).withColumn("offer_type", F.when(F.col("noise") < 0.3, "bogo").otherwise("discount"))
    mixed = uplift_metrics.shuffle_treatment(df, 42)
    sizes = lambda d: sorted(map(tuple, d.groupBy("offer_type", "treatment").count().collect()))
    assert sizes(df) == sizes(mixed)
    moved = mixed.select("account_id", F.col("treatment").alias("new")).join(df, "account_id").where("new <> treatment").count()
    assert moved > 50
    other = uplift_metrics.shuffle_treatment(df, 42, 1).select("account_id", "treatment").exceptAll(mixed.select("account_id", "treatment"))
    assert other.count() > 0


def test_placebo_verdict(spark, cfg):
    null = spark.createDataFrame([(x / 100,) for x in range(20)], "qini double")
    row = uplift_metrics.placebo_verdict(0.5, null, cfg).first()
    assert row["passed"] and row["p_value"] == 0.0 and row["threshold"] == pytest.approx(0.1805)
    assert not uplift_metrics.placebo_verdict(0.1, null, cfg).first()["passed"]


def test_quadrants(spark, cfg):
    df = spark.createDataFrame([(0.5, 0.1), (-0.5, 0.9), (0.0, 0.9), (0.012, 0.5), (-0.012, 0.4)], "uplift double, p_convert double")
    got = [r["quadrant"] for r in quadrant.add_quadrant(df, cfg).collect()]
    assert got == ["persuadable", "sleeping_dog", "sure_thing", "sure_thing", "lost_cause"]


def _ranked(spark, rows):
    data = [(f"a{i}", "o", 0.0, *r, i + 1) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "account_id string, offer_id string, received_time double, quadrant string,"
                                       " treatment int, converted int, net_profit double, uplift double, rank long")


def test_quadrant_without_control_is_not_evaluable(spark):
    ranked = _ranked(spark, [("persuadable", 1, 1, 10.0, 0.4), ("persuadable", 1, 1, 20.0, 0.2),
                             ("sure_thing", 1, 1, 10.0, 0.0), ("sure_thing", 0, 0, 0.0, 0.0), ("lost_cause", 1, 1, 9.0, 0.0)])
    rows = {r["quadrant"]: r for r in quadrant.gain_by_quadrant(ranked, 4).collect()}
    assert rows["persuadable"]["gain"] is None and not rows["persuadable"]["evaluable"]
    assert rows["persuadable"]["mean_tau"] == pytest.approx(0.3)
    assert rows["sure_thing"]["gain"] == pytest.approx(10.0) and "lost_cause" not in rows
    mix = {r["quadrant"]: (r["n"], r["share"]) for r in quadrant.composition_at_budget(ranked, 4).collect()}
    assert mix == {"persuadable": (2, 0.5), "sure_thing": (2, 0.5)}


def test_left_on_table(spark):
    reference = _ranked(spark, [("persuadable", 1, 1, 1.0, 0.5)] * 3 + [("lost_cause", 1, 0, 0.0, 0.0)] * 3)
    chosen = reference.withColumn("rank", F.expr("CASE account_id WHEN 'a0' THEN 1 WHEN 'a3' THEN 2 WHEN 'a4' THEN 3 ELSE 9 END"))
    row = quadrant.left_on_table(reference, chosen, 3).first()
    assert (row["persuadables"], row["missed"]) == (3, 2) and row["missed_share"] == pytest.approx(2 / 3)
    none = quadrant.left_on_table(reference.where("quadrant = 'lost_cause'"), chosen, 3).first()
    assert none["persuadables"] == 0 and none["missed_share"] is None


def test_temporal_split_and_order(spark, cfg):
    rows = [("a", 0.0, 0), ("a", 7.0, 3), ("b", 14.0, 4), ("b", 21.0, 5)]
    df = spark.createDataFrame(rows, "account_id string, received_time double, campaign_wave int")
    train, holdout = temporal_split(df, cfg)
    assert (train.count(), holdout.count()) == (2, 2)
    assert temporal_order(train, holdout, strict=True).first()["in_order"]
    with pytest.raises(ValueError, match="training reaches"):
        temporal_order(holdout, train, strict=True)
    with pytest.raises(ValueError, match="empty"):
        temporal_order(train, holdout.where("false"), strict=True)


def test_recommend_one_offer_per_customer(spark):
    pairs = spark.createDataFrame([
        ("a", "o1", "bogo", 0.9), ("a", "o2", "discount", 0.4), ("b", "o1", "bogo", 0.5), ("b", "o2", "discount", 0.8),
        ("c", "o1", "bogo", 0.1), ("c", "o2", "discount", 0.1), ("d", "o1", "bogo", None),
    ], "account_id string, offer_id string, offer_type string, score double")
    rows = sorted(serving.recommend(pairs, 2).collect(), key=lambda r: r["rank"])
    assert [(r["rank"], r["account_id"], r["offer_id"]) for r in rows] == [(1, "a", "o1"), (2, "b", "o2")]
    every = {r["account_id"]: r["offer_id"] for r in serving.recommend(pairs, 10).collect()}
    assert every == {"a": "o1", "b": "o2", "c": "o1"}
    warm = [serving.recommend(pairs, 2, 1.0, 7).collect() for _ in range(2)]
    assert warm[0] == warm[1]


def _matrix(spark):
    return spark.createDataFrame([
        ("a", "o1", "bogo", 0.3, 0.4, 0.8, "persuadable"), ("a", "o3", "informational", None, None, None, None),
        ("b", "o1", "bogo", 0.0, 0.9, 0.6, "sure_thing"), ("b", "o2", "discount", 0.1, 0.2, 0.7, "persuadable"),
        ("c", "o1", "bogo", -0.2, 0.6, 0.1, "sleeping_dog"),
    ], "account_id string, offer_id string, offer_type string, uplift double, p_convert double, score_dynamic double, quadrant string")


def test_allocation_equals_recommend_and_reports_exhaustion(spark, make_offers):
    rows = serving.eligible(_matrix(spark), ["bogo", "discount", "informational"], ["persuadable", "sure_thing"])
    out = serving.allocate(rows, 5, 42)
    uplift = sorted((r["rank"], r["account_id"], r["offer_id"]) for r in out.where("strategy = 'uplift'").collect())
    plain = serving.recommend(rows.withColumn("score", F.col("score_dynamic")), 5)
    assert uplift == sorted((r["rank"], r["account_id"], r["offer_id"]) for r in plain.collect())
    assert out.where("offer_type = 'informational'").count() == 0
    size = {r["strategy"]: (r["eligible"], r["sent"], r["exhausted"]) for r in serving.audience_size(rows, 5).collect()}
    assert size["uplift"] == (2, 2, True)
    offers = make_offers(("o1", "bogo", 5, 4, 7), ("o2", "discount", 5, 2, 7))
    means = spark.createDataFrame([(10.0, 20.0)], "mean_profit double, mean_revenue double")
    totals = {r["strategy"]: r for r in serving.project(out, offers, means).collect()}
    assert totals["conversion"]["expected_conversions"] == pytest.approx(1.3)
    assert totals["uplift"]["projected_profit"] == pytest.approx(4.0)
    assert totals["uplift"]["expected_discount"] == pytest.approx(0.4 * 4 + 0.2 * 2)
    assert math.isclose(totals["conversion"]["expected_revenue"], 26.0)


def test_segment_filter(spark):
    segments = spark.createDataFrame([("a", "x"), ("b", "y")], "account_id string, segment string")
    rows = serving.eligible(_matrix(spark), ["bogo", "discount"], ["persuadable", "sure_thing"], segments, ["y"])
    assert {r["account_id"] for r in rows.collect()} == {"b"}


def test_scoring_grid_and_history(make_events, make_offers, spark, cfg):
    from offertide.settings import BOUGHT, SENT

    offers = make_offers(("o1", "bogo", 5, 4, 7), ("o2", "discount", 5, 2, 7), ("o3", "informational", 0, 0, 3))
    events = make_events(("a", BOUGHT, 1.0, None, 10.0), ("a", BOUGHT, 9.0, None, 99.0), ("a", SENT, 3.0, "o1"))
    profile = spark.createDataFrame(
        [("a", 30, "F", 1.0, 0, 5), ("b", 40, "M", 2.0, 0, 6)],
        "account_id string, age int, gender string, credit_card_limit double, identity_missing int, tenure_days int")
    at = serving.decision_time(events).first()[0]
    assert at == 9.0 and serving.decision_time(events, 4.5).first()[0] == 4.5
    frame = serving.build_scoring_frame(events, offers, profile, at, cfg, serving.paid_offers(offers)).cache()
    assert frame.count() == 4 and frame.where("treatment <> 1 OR reward_cost <> 0 OR received_time <> 9").count() == 0
    assert frame.where("account_id = 'a'").first()["hist_spend_total"] == 10.0
    assert {r[0] for r in frame.select("n_concurrent_offers").collect()} == {1}
    real = serving.build_scoring_frame(events, offers, profile, at, cfg, offers.where("id = 'o1'"), receipts=events.where("event = 'offer received'").selectExpr(
        "account_id", "offer_ref AS offer_id", "time AS received_time"))
    assert {r["account_id"]: r["n_concurrent_offers"] for r in real.collect()} == {"a": 1, "b": 0}


def test_the_grid_is_never_stored_and_its_terms_are_joined_before_it(make_events, make_offers, spark, cfg):
    from offertide.settings import BOUGHT, SENT

    offers = make_offers(("o1", "bogo", 5, 4, 7), ("o2", "discount", 5, 2, 7))
    events = make_events(("a", BOUGHT, 1.0, None, 10.0), ("a", SENT, 3.0, "o1"))
    profile = spark.createDataFrame(
        [("a", 30, "F", 1.0, 0, 5), ("b", 40, "M", 2.0, 0, 6)],
        "account_id string, age int, gender string, credit_card_limit double, identity_missing int, tenure_days int")
    frame = serving.build_scoring_frame(events, offers, profile, 9.0, cfg)
    assert frame.count() == 4
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    # One join of stored customers with the terms; history and catalogue joins lie before it.
    assert plan.count("Join ") == 1 and "Aggregate" not in plan


def test_grid_is_dealt_to_tasks_by_its_rows(spark, cfg, make_events, make_offers):
    events = make_events(("a", "offer received", 0.0, "o1", None))
    offers = make_offers(("o1", "bogo", 10, 5, 7), ("o2", "discount", 10, 2, 7), ("o3", "discount", 20, 5, 9))
    names = [f"c{k}" for k in range(40)]
    profile = spark.createDataFrame(
        [(n, 30, "F", 100.0, 0, 50) for n in names],
        "account_id string, age int, gender string, credit_card_limit double, identity_missing int, tenure_days int")
    frame = serving.build_scoring_frame(events, offers, profile, 9.0, cfg.but(grid_rows_per_task=5))
    assert frame.rdd.getNumPartitions() == 24
    assert sorted((r["account_id"], r["offer_id"]) for r in frame.collect()) == sorted((n, o) for n in names for o in ("o1", "o2", "o3"))
