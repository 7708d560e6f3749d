"""Ownership with the offer class as a sweep key, against brute force, and skewed joins."""

from __future__ import annotations

import dataclasses
import random
from collections import Counter

import pytest

from offertide.functions.joins import keyed_join
from offertide.functions.timeline import find_hot_keys
from offertide.operators import attribution as at
from offertide.operators import clean
from offertide.settings import EARLIEST, LATEST

SENT, BOUGHT = "offer received", "transaction"


def _world(seed, n_offers=40):
    rnd = random.Random(seed)
    offers = [(f"o{k}", "bogo", rnd.choice([0, 5, 10, 20]), 2, rnd.choice([1.0, 3.0, 3.0, 7.5])) for k in range(n_offers)]

    sent, bought = [], []
    for account in ["hot"] * 12 + ["a", "b", "c"]:
        sent += [(account, rnd.choice(offers)[0] if rnd.random() < 0.95 else "gone", float(rnd.randrange(30))) for _ in range(6)]
        bought += [(account, rnd.randrange(120) / 4, float(rnd.choice([1, 5, 7, 12, 30]))) for _ in range(8)]
    bought += bought[:9] + [("d", 3.0, 9.0)]
    return offers, sorted(set(sent)), bought


def _brute(offers, sent, bought, priority):
    terms = {o[0]: (o[2], o[4]) for o in offers}
    owned, candidates = [], []
    for account, t, amount in bought:
        fit = [(r, o) for a, o, r in sent if a == account and o in terms and r <= t <= r + terms[o][1] and amount >= terms[o][0]]
        if fit:
            r, o = min(fit, key=lambda x: (x[0] if priority == EARLIEST else -x[0], x[1]))
            owned.append((account, o, r, t, amount))
            candidates.append((account, t, amount, len(fit)))
    return Counter(owned), Counter(candidates)


@pytest.mark.parametrize("priority", [EARLIEST, LATEST])
@pytest.mark.parametrize("cut", ["none", "few", "many"])
def test_ownership_equals_brute_force(spark, cfg, make_events, make_offers, priority, cut):
    offers, sent, bought = _world(len(cut) + len(priority))
    events = make_events(*[(a, SENT, r, o) for a, o, r in sent], *[(a, BOUGHT, t, None, m) for a, t, m in bought])
    hot = None if cut == "none" else dataclasses.replace(find_hot_keys(events, "account_id", "time", 15), few=cut == "few")
    cfg = cfg.but(attribution_priority=priority)
    received = at.with_validity(clean.receipts(events), make_offers(*offers))
    owned, candidates = _brute(offers, sent, bought, priority)
    got = at.owned_transactions(received, clean.transactions(events), cfg, hot)
    assert Counter(map(tuple, got.select("account_id", "offer_id", "received_time", "txn_time", "txn_amount").collect())) == owned
    found = at.candidate_transactions(received, clean.transactions(events), hot)
    assert Counter(map(tuple, found.select("account_id", "txn_time", "txn_amount", "n_candidates").collect())) == candidates


def test_plan_does_not_grow_with_the_catalogue(spark, cfg, make_events, make_offers):
    events = make_events(("a", SENT, 0.0, "o1"), ("a", BOUGHT, 1.0, None, 20.0))
    sizes = []
    for n in (10, 5000):
        offers = make_offers(*[(f"o{k}", "bogo", k % 50, 2, 1 + k % 97) for k in range(n)])
        received = at.with_validity(clean.receipts(events), offers)
        owned = at.owned_transactions(received, clean.transactions(events), cfg)
        sizes.append(len(owned._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        assert owned.count() == 1
    assert sizes[0] == sizes[1]


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_keyed_join_equals_a_plain_join(spark, few, how):
    rows = spark.createDataFrame([(None if k == 3 else "hot" if k % 3 else f"k{k}", float(k % 40), k) for k in range(400)], "key string, at double, n int")
    side = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("none", 4), (None, 5)], "key string, v int")
    hot = dataclasses.replace(find_hot_keys(rows, "key", "at", 50), few=few)
    want = Counter(map(tuple, rows.join(side, "key", how).collect()))
    assert Counter(map(tuple, keyed_join(rows, side, "key", hot, how).select("key", "at", "n", "v").collect())) == want
    tagged = hot.tag(rows, "at").groupBy("key", "_segment").count().collect()
    assert max(r["count"] for r in tagged if r["key"] == "hot") < 100 and {r["_segment"] for r in tagged if r["key"] != "hot"} == {-1}
