"""The staged log between runs, and the worst pair of offers without their pairs."""

from __future__ import annotations

import random

import pytest

from offertide.operators import describe
from offertide.plans import history
from offertide.sources import files

SCHEMA = "account_id string, event string, time_since_test_start double, value struct<`offer id`: string, offer_id: string, amount: double, reward: double>"


@pytest.fixture
def days(spark, tmp_path):
    def add(day, rows):
        spark.createDataFrame([(a, e, t, (r, None, None, None)) for a, e, t, r in rows], SCHEMA).coalesce(1).write.json(f"{tmp_path}/raw/day={day}")

    seen = []

    def parse(paths):
        seen.append(len(paths))
        return files.parse_events(files.read_events(spark, paths))

    return f"{tmp_path}/raw", f"{tmp_path}/store", add, parse, seen


def _rows(spark, store, since=None):
    return sorted(tuple(r) for r in history.staged(spark, store, files.FLAT_SCHEMA, since).select("account_id", "event", "time", "offer_ref").collect())


def test_only_new_files_are_parsed(spark, days):
    raw, store, add, parse, seen = days
    assert _rows(spark, store) == []
    add(1, [("a", "offer received", 0.0, "o1")])
    assert history.refresh(spark, raw, store, parse) == 1
    add(2, [("a", "offer viewed", 1.5, "o1"), ("b", "offer received", 1.0, "o2")])
    assert history.refresh(spark, raw, store, parse) == 1 and history.refresh(spark, raw, store, parse) == 0
    assert seen == [1, 1]
    want = [("a", "offer received", 0.0, "o1"), ("a", "offer viewed", 1.5, "o1"), ("b", "offer received", 1.0, "o2")]
    assert _rows(spark, store) == want and _rows(spark, store, 1.0) == want[1:]


def test_a_failed_run_leaves_nothing_behind(spark, days, monkeypatch):
    raw, store, add, parse, _ = days
    add(1, [("a", "offer received", 0.0, "o1")])
    history.refresh(spark, raw, store, parse)
    add(2, [("b", "offer received", 1.0, "o2")])

    def half(paths):
        parse(paths).write.partitionBy("event").parquet(f"{store}/half")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        history.refresh(spark, raw, store, half)
    assert len(_rows(spark, store)) == 1
    assert history.refresh(spark, raw, store, parse) == 1 and len(_rows(spark, store)) == 2


def test_a_changed_file_is_refused(spark, days, tmp_path):
    raw, store, add, parse, _ = days
    add(1, [("a", "offer received", 0.0, "o1")])
    history.refresh(spark, raw, store, parse)
    part = next((tmp_path / "raw" / "day=1").glob("part-*.json"))
    part.write_text(part.read_text() * 2)
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="changed"):
        history.refresh(spark, raw, store, parse)


@pytest.mark.parametrize("seed", range(3))
def test_worst_pair_equals_all_pairs(spark, cfg, seed):
    rnd = random.Random(seed)
    rows = []
    for k in range(40):
        age = rnd.choice([None, 30.0, 45.0]) if k % 5 == 0 else None
        for _ in range(1 if k % 7 == 0 else 6):
            rows.append((f"o{k}", age if k % 5 == 0 else rnd.gauss(40, 1 + k % 4), rnd.gauss(k % 3, 0.1), rnd.randrange(9), int(rnd.random() < 0.1), rnd.choice("FMO")))
    df = spark.createDataFrame(rows, "offer_id string, age double, credit_card_limit double, tenure_days int, identity_missing int, gender string")
    wide, names = describe._covariates(df, describe.PROFILE_COVARIATES)
    stats = {}
    for r in describe._moments_long(wide, "offer_id", names).collect():
        stats.setdefault(r["covariate"], []).append((r["mean"], r["var"]))
    want = {c: max([0.0] + [abs(a[0] - b[0]) / ((a[1] + b[1]) / 2) ** 0.5 for i, a in enumerate(v) for b in v[:i]
                            if None not in (a[0], b[0]) and a[1] + b[1] > 0]) for c, v in stats.items()}
    got = {r["covariate"]: r["worst_abs_smd"] for r in describe.assignment_balance(df, cfg).collect()}
    assert got == pytest.approx(want)
