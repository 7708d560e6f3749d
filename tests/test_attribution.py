import random

import duckdb
import pytest

from offertide.functions.timeline import find_hot_keys
from offertide.operators import attribution as at
from offertide.operators import clean
from offertide.plans.processed import label_receipts
from offertide.settings import BOUGHT, EARLIEST, LATEST, SEEN, SENT

from conftest import by_key

GRAIN = ("account_id", "offer_id", "received_time")


def _run(events, offers, cfg):
    return by_key(at.build_label(at.attribute(events, offers, cfg)), *GRAIN)


@pytest.mark.parametrize("priority, winner", [(EARLIEST, ("a", "o1", 0.0)), (LATEST, ("a", "o2", 2.0))])
def test_one_purchase_two_open_offers(make_events, make_offers, cfg, priority, winner):
    offers = make_offers(("o1", "bogo", 5, 5, 10), ("o2", "discount", 5, 2, 10))
    events = make_events(("a", SENT, 0.0, "o1"), ("a", SENT, 2.0, "o2"), ("a", BOUGHT, 3.0, None, 20.0))
    out = _run(events, offers, cfg.but(attribution_priority=priority))
    assert [k for k, r in out.items() if r["converted"]] == [winner]


def test_minimum_is_applied_before_ownership(make_events, make_offers, cfg):
    offers = make_offers(("o1", "bogo", 50, 5, 10), ("o2", "discount", 10, 2, 10))
    events = make_events(("a", SENT, 0.0, "o1"), ("a", SENT, 1.0, "o2"), ("a", BOUGHT, 3.0, None, 15.0))
    out = _run(events, offers, cfg)
    assert out["a", "o1", 0.0]["converted"] == 0 and out["a", "o2", 1.0]["conversion_value"] == 15.0


def test_view_marks_only_the_receipt_it_falls_into(make_events, make_offers, cfg):
    offers = make_offers(("o1", "bogo", 5, 5, 7))
    events = make_events(("a", SENT, 0.0, "o1"), ("a", SENT, 10.0, "o1"), ("a", SEEN, 11.0, "o1"), ("a", BOUGHT, 12.0, None, 8.0))
    out = _run(events, offers, cfg)
    assert out["a", "o1", 0.0]["view_time"] is None and out["a", "o1", 0.0]["converted"] == 0
    assert out["a", "o1", 10.0]["view_time"] == 11.0 and out["a", "o1", 10.0]["converted"] == 1


def test_one_view_marks_one_of_two_overlapping_sends(make_events, make_offers, cfg):
    offers = make_offers(("o1", "bogo", 5, 5, 20))
    events = make_events(("a", SENT, 0.0, "o1"), ("a", SENT, 5.0, "o1"), ("a", SEEN, 6.0, "o1"))
    seen = [k for k, r in _run(events, offers, cfg).items() if r["view_time"] is not None]
    assert seen == [("a", "o1", 0.0)]


def test_minimum_is_per_purchase(make_events, make_offers, cfg):
    offers = make_offers(("o1", "bogo", 10, 5, 7))
    events = make_events(("a", SENT, 0.0, "o1"), ("a", BOUGHT, 1.0, None, 6.0), ("a", BOUGHT, 2.0, None, 6.0))
    assert _run(events, offers, cfg)["a", "o1", 0.0]["converted"] == 0


def test_later_owned_purchase_is_consumed(make_events, make_offers, cfg):
    offers = make_offers(("o1", "bogo", 5, 5, 10), ("o2", "discount", 5, 2, 10))
    events = make_events(("a", SENT, 0.0, "o1"), ("a", SENT, 1.0, "o2"),
                         ("a", BOUGHT, 2.0, None, 9.0), ("a", BOUGHT, 3.0, None, 30.0))
    out = _run(events, offers, cfg)
    assert out["a", "o1", 0.0]["conversion_value"] == 9.0 and out["a", "o2", 1.0]["converted"] == 0


def test_intervals_are_closed(make_events, make_offers, cfg):
    offers = make_offers(("o1", "bogo", 10, 5, 7))
    events = make_events(("a", SENT, 1.0, "o1"), ("a", BOUGHT, 8.0, None, 10.0), ("b", SENT, 1.0, "o1"),
                         ("b", BOUGHT, 1.0, None, 10.0), ("c", SENT, 1.0, "o1"), ("c", BOUGHT, 8.001, None, 10.0))
    assert {k[0]: r["converted"] for k, r in _run(events, offers, cfg).items()} == {"a": 1, "b": 1, "c": 0}


def test_unknown_offer_and_repeated_send_are_kept(make_events, make_offers, cfg):
    offers = make_offers(("o1", "bogo", 5, 5, 7))
    events = make_events(("a", SENT, 0.0, "nope"), ("a", SENT, 0.0, "o1"), ("a", SENT, 0.0, "o1"), ("a", BOUGHT, 1.0, None, 9.0))
    rows = at.attribute(events, offers, cfg).collect()
    assert len(rows) == 3
    assert sorted((r["offer_id"], r["assigned_txn_count"]) for r in rows) == [("nope", 0), ("o1", 1), ("o1", 1)]


@pytest.mark.parametrize("days, expected", [(7, 1), (3, 0)])
def test_recurrence_window(make_events, make_offers, cfg, days, expected):
    offers = make_offers(("o1", "bogo", 5, 5, 2), ("o2", "discount", 5, 2, 2))
    events = make_events(("a", SENT, 0.0, "o1"), ("a", SENT, 5.0, "o2"), ("a", BOUGHT, 1.0, None, 9.0), ("a", BOUGHT, 6.0, None, 9.0))
    out = by_key(label_receipts(events, offers, cfg.but(recurrence_window_days=days)), *GRAIN)
    assert out["a", "o1", 0.0]["is_recurrent"] == expected and out["a", "o2", 5.0]["is_recurrent"] == 0


def test_equal_conversion_times_do_not_recur(make_events, make_offers, cfg):
    offers = make_offers(("o1", "bogo", 5, 5, 2), ("o2", "discount", 5, 2, 2))
    events = make_events(("a", SENT, 0.0, "o1"), ("a", SENT, 0.0, "o2"), ("a", BOUGHT, 1.0, None, 9.0), ("a", BOUGHT, 1.0, None, 9.0))
    rows = label_receipts(events, offers, cfg).collect()
    assert sum(r["converted"] for r in rows) == 1 and sum(r["is_recurrent"] for r in rows) == 0


def test_overlap_report_counts_contested_purchases(make_events, make_offers, cfg):
    offers = make_offers(("o1", "bogo", 5, 5, 10), ("o2", "discount", 15, 2, 10))
    events = make_events(("a", SENT, 0.0, "o1"), ("a", SENT, 1.0, "o2"), ("a", BOUGHT, 3.0, None, 20.0),
                         ("a", BOUGHT, 4.0, None, 6.0), ("a", BOUGHT, 30.0, None, 60.0))
    received = at.with_validity(clean.receipts(events), offers)
    found = at.candidate_transactions(received, clean.transactions(events))
    assert sorted((r["txn_time"], r["n_candidates"]) for r in found.collect()) == [(3.0, 2), (4.0, 1)]
    report = at.overlap_report(found).first()
    assert (report["eligible_txns"], report["contested_txns"], report["most_candidates"]) == (2, 1, 2)


BRUTE = """
WITH base AS (SELECT e.account_id, e.offer_ref AS offer_id, e.time AS received_time, o.min_value, e.time + o.duration AS valid_until
  FROM ev e LEFT JOIN off o ON o.id = e.offer_ref WHERE e.event = 'offer received'),
tx AS (SELECT row_number() OVER () AS id, account_id, time AS t, amount AS a FROM ev WHERE event = 'transaction'),
own AS (SELECT * FROM (SELECT b.account_id, b.offer_id, b.received_time, tx.t, tx.a, row_number() OVER (
  PARTITION BY tx.id ORDER BY b.received_time {dir}, b.offer_id) AS k FROM base b JOIN tx ON tx.account_id = b.account_id
  AND tx.t BETWEEN b.received_time AND b.valid_until AND tx.a >= b.min_value) WHERE k = 1),
vw AS (SELECT * FROM (SELECT b.account_id, b.offer_id, b.received_time, v.time AS vt, row_number() OVER (
  PARTITION BY b.account_id, b.offer_id, v.time ORDER BY b.received_time {dir}) AS k FROM base b JOIN ev v ON v.account_id = b.account_id
  AND v.event = 'offer viewed' AND v.offer_ref = b.offer_id AND v.time BETWEEN b.received_time AND b.valid_until) WHERE k = 1)
SELECT b.account_id, b.offer_id, b.received_time,
  (SELECT min(vt) FROM vw WHERE vw.account_id = b.account_id AND vw.offer_id = b.offer_id AND vw.received_time = b.received_time) AS view_time,
  (SELECT min(t) FROM own WHERE own.account_id = b.account_id AND own.offer_id = b.offer_id AND own.received_time = b.received_time) AS txn_time
FROM base b
"""


def random_log(seed, n=700):
    rng = random.Random(seed)
    rows, sent = [], set()
    for i in range(n):
        account = "hot" if i % 3 == 0 else f"c{rng.randrange(12)}"
        offer = f"o{rng.randrange(5)}"
        kind = rng.choice([SENT, SENT, SEEN, BOUGHT, BOUGHT, BOUGHT])
        time = rng.randrange(120) / 4
        if kind == SENT:
            if (account, offer, time) in sent:
                continue
            sent.add((account, offer, time))
        rows.append((account, kind, time, None if kind == BOUGHT else offer,
                     float(rng.randrange(1, 40)) if kind == BOUGHT else None))
    return rows


@pytest.mark.parametrize("priority", [EARLIEST, LATEST])
@pytest.mark.parametrize("rows_per_task", [10**6, 20])
def test_random_logs_equal_the_interval_join(make_events, make_offers, cfg, priority, rows_per_task):
    terms = [("o0", "bogo", 5, 5, 3), ("o1", "bogo", 10, 5, 7), ("o2", "discount", 10, 3, 7),
             ("o3", "discount", 20, 3, 10), ("o4", "informational", 0, 0, 4)]
    log = random_log(11)
    events, offers = make_events(*log), make_offers(*terms)
    hot = find_hot_keys(events, "account_id", "time", rows_per_task)
    assert (hot is None) == (rows_per_task == 10**6)
    got = at.attribute(events, offers, cfg.but(attribution_priority=priority), hot).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE ev (account_id TEXT, event TEXT, time DOUBLE, offer_ref TEXT, amount DOUBLE)")
    con.executemany("INSERT INTO ev VALUES (?, ?, ?, ?, ?)", log)
    con.execute("CREATE TABLE off (id TEXT, min_value DOUBLE, duration DOUBLE)")
    con.executemany("INSERT INTO off VALUES (?, ?, ?)", [(t[0], t[2], t[4]) for t in terms])
    want = con.execute(BRUTE.format(dir="ASC" if priority == EARLIEST else "DESC")).fetchall()
    assert sorted(map(str, want)) == sorted(
        str((r["account_id"], r["offer_id"], r["received_time"], r["view_time"], r["first_assigned_txn_time"])) for r in got)
