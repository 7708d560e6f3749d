import math
import random
import statistics

import pytest

from offertide.functions.timeline import find_hot_keys
from offertide.operators import clean, features
from offertide.operators.contract import NULLABLE, check_schema
from offertide.operators.quality import duplicate_grain, require_clean, unexpected_nulls, value_domains
from offertide.plans.processed import build_processed, campaign_waves
from offertide.settings import BOUGHT, DONE, SEEN, SENT

from conftest import by_key
from test_attribution import random_log

KEY = ("account_id", "offer_id", "received_time")
TERMS = [("o0", "bogo", 5, 5, 3), ("o1", "bogo", 10, 5, 7), ("o2", "discount", 10, 3, 7),
         ("o3", "discount", 20, 3, 10), ("o4", "informational", 0, 0, 4, ["web", "email", "mobile", "social"])]


def test_later_and_simultaneous_events_are_not_seen(make_events, make_offers):
    events = make_events(("a", SENT, 10.0, "o1"), ("a", BOUGHT, 4.0, None, 10.0), ("a", BOUGHT, 10.0, None, 500.0),
                         ("a", BOUGHT, 11.0, None, 999.0))
    out = features.add_features(events, clean.receipts(events), make_offers(*TERMS)).first()
    assert out["hist_spend_total"] == 10.0 and out["hist_txn_count"] == 1 and out["hist_recency_days"] == 6.0


def test_empty_history_is_kept(make_events, make_offers):
    events = make_events(("a", SENT, 0.0, "o1"))
    out = features.add_features(events, clean.receipts(events), make_offers(*TERMS)).first()
    assert out["hist_txn_count"] == 0 and out["hist_frequency"] == 0.0 and out["hist_spend_trend"] == 0.0
    assert out["hist_recency_days"] is None and out["hist_time_view_to_conv"] is None
    assert out["n_concurrent_offers"] == 0 and out["hist_view_rate"] == 0.0


def test_trend_splits_at_half_time(make_events, make_offers):
    events = make_events(("a", SENT, 10.0, "o1"), ("a", BOUGHT, 4.0, None, 10.0), ("a", BOUGHT, 5.0, None, 30.0))
    out = features.add_features(events, clean.receipts(events), make_offers(*TERMS)).first()
    assert out["hist_spend_trend"] == 20.0


def test_unseen_completion_and_delay(make_events, make_offers):
    events = make_events(("a", SENT, 20.0, "o1"), ("a", SEEN, 1.0, "o2"), ("a", SEEN, 3.0, "o2"), ("a", DONE, 5.0, "o2"),
                         ("a", DONE, 6.0, "o3"), ("a", SEEN, 7.0, "o3"), ("b", SENT, 20.0, "o1"), ("b", SEEN, 2.0, "o2"),
                         ("b", DONE, 2.0, "o2"))
    out = by_key(features.add_features(events, clean.receipts(events), make_offers(*TERMS)), *KEY)
    a, b = out["a", "o1", 20.0], out["b", "o1", 20.0]
    assert a["hist_completed_unseen_flag"] == 1 and a["hist_time_view_to_conv"] == 2.0
    assert b["hist_completed_unseen_flag"] == 0 and b["hist_time_view_to_conv"] == 0.0


def test_catalogue_terms(make_events, make_offers):
    events = make_events(("a", SENT, 0.0, "o4"), ("a", SENT, 0.0, "o1"))
    out = by_key(features.offer_terms(clean.receipts(events), make_offers(*TERMS)), *KEY)
    info, bogo = out["a", "o4", 0.0], out["a", "o1", 0.0]
    assert info["n_channels"] == 4 and info["discount_to_minvalue_ratio"] == 0.0 and info["channel_social"] == 1
    assert bogo["n_channels"] == 2 and bogo["channel_mobile"] == 0 and bogo["discount_to_minvalue_ratio"] == 0.5


def _brute(log, terms):
    kind = {t[0]: t[1] for t in terms}
    span = {t[0]: t[4] for t in terms}
    sent = [(a, o, t) for a, e, t, o, _ in log if e == SENT]
    out = {}
    for account, offer, at in sent:
        past = [r for r in log if r[0] == account and r[2] < at]
        money = [(t, v) for _, e, t, _, v in past if e == BOUGHT]
        values = [v for _, v in money]
        late, early = [v for t, v in money if t >= at / 2], [v for t, v in money if t < at / 2]
        mean = lambda xs: sum(xs) / len(xs) if xs else 0.0
        n = lambda e, k=None: sum(1 for r in past if r[1] == e and (k is None or kind[r[3]] == k))
        done = {(o, t) for _, e, t, o, _ in past if e == DONE}
        last = {(o, t): max((v for a, e, v, w, _ in log if a == account and e == SEEN and w == o and v <= t), default=None)
                for o, t in done}
        delays = [t - v for (o, t), v in last.items() if v is not None]
        out[account, offer, at] = {
            "hist_spend_total": sum(values), "hist_txn_count": len(values), "hist_avg_ticket": mean(values),
            "hist_spend_std": statistics.stdev(values) if len(values) > 1 else 0.0,
            "hist_recency_days": at - max(t for t, _ in money) if money else None,
            "hist_frequency": len(values) / at if at > 0 else 0.0, "hist_spend_trend": mean(late) - mean(early),
            "hist_offers_received": n(SENT), "hist_offers_viewed": n(SEEN), "hist_offers_completed": n(DONE),
            "hist_offers_received_bogo": n(SENT, "bogo"), "hist_offers_received_info": n(SENT, "informational"),
            "hist_view_rate": n(SEEN) / n(SENT) if n(SENT) else 0.0,
            "hist_conv_rate_discount": n(DONE, "discount") / n(SENT, "discount") if n(SENT, "discount") else 0.0,
            "hist_completed_unseen_flag": int(any(v is None for v in last.values())),
            "hist_time_view_to_conv": mean(delays) if delays else None,
            "n_concurrent_offers": sum(1 for a, o, t in sent if a == account and t <= at <= t + span[o]) - 1,
        }
    return out


@pytest.mark.parametrize("rows_per_task", [10**6, 20])
def test_random_logs_equal_brute_force(make_events, make_offers, rows_per_task):
    rng = random.Random(3)
    log = [(a, DONE if e == SEEN and rng.random() < 0.5 else e, t, o, v) for a, e, t, o, v in random_log(23, 500)]
    events = make_events(*log)
    hot = find_hot_keys(events, "account_id", "time", rows_per_task)
    got = by_key(features.add_features(events, clean.receipts(events), make_offers(*TERMS), hot=hot), *KEY)
    want = _brute(log, TERMS)
    assert got.keys() == want.keys()
    for key, expected in want.items():
        for name, value in expected.items():
            have = got[key][name]
            if value is None:
                assert have is None, (key, name)
            else:
                assert math.isclose(have, value, rel_tol=1e-9, abs_tol=1e-9), (key, name, have, value)


def _profile(spark, accounts):
    return spark.createDataFrame(
        [(a, None if a == "hot" else 30, "unknown" if a == "hot" else "F", None if a == "hot" else 100.0, int(a == "hot"), 10)
         for a in accounts],
        "account_id string, age int, gender string, credit_card_limit double, identity_missing int, tenure_days int")


@pytest.mark.parametrize("rows_per_task", [10**6, 20])
def test_processed_table_keeps_the_contract(spark, make_events, make_offers, cfg, rows_per_task):
    log = random_log(31, 400)
    events = make_events(*log)
    profile = _profile(spark, sorted({r[0] for r in log}))
    hot = find_hot_keys(events, "account_id", "time", rows_per_task)
    processed = build_processed(events, make_offers(*TERMS), profile, cfg, hot).cache()
    check_schema(processed, strict=True)
    unexpected_nulls(processed, strict=True)
    require_clean(value_domains(processed))
    require_clean(duplicate_grain(processed))
    assert processed.count() == sum(r[1] == SENT for r in log)
    assert processed.where("converted = 1 AND conversion_value < min_value").count() == 0
    assert processed.where("treatment = 0 AND converted = 1").count() > 0
    assert processed.where("offer_type = 'informational' AND reward_cost > 0").count() == 0
    assert processed.where("offer_type = 'informational' AND converted = 1").count() > 0
    paid = processed.where("converted = 1 AND offer_type <> 'informational'")
    assert paid.where("reward_cost <> discount_value").count() == 0 and paid.where("treatment = 0").count() > 0
    processed.unpersist()


def test_injected_null_is_found(spark, make_events, make_offers, cfg):
    events = make_events(("a", SENT, 0.0, "o1"))
    processed = build_processed(events, make_offers(*TERMS), _profile(spark, ["a"]), cfg)
    unexpected_nulls(processed, strict=True)
    assert {"age", "credit_card_limit"} < NULLABLE
    with pytest.raises(ValueError, match="gender"):
        unexpected_nulls(processed.selectExpr(*[c if c != "gender" else "CAST(NULL AS STRING) AS gender" for c in processed.columns]), strict=True)


@pytest.mark.parametrize("limit", [2, 100])
def test_waves_are_dense_in_time_order(make_events, cfg, limit):
    events = make_events(*[("a", SENT, t, "o1") for t in (0.0, 7.0, 24.0, 21.0)], ("b", SENT, 7.0, "o2"))
    waves = campaign_waves(clean.receipts(events), cfg.but(small_table_rows=limit))
    assert sorted((r["received_time"], r["campaign_wave"]) for r in waves.collect()) == [(0.0, 0), (7.0, 1), (21.0, 2), (24.0, 3)]
