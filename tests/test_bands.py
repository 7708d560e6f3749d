from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from offertide.arrays.draws import uniforms
from offertide.functions.draws import keyed_uniform
from offertide.operators import gain


@pytest.fixture
def holdout(spark):
    rng = random.Random(5)

    def build(n):
        rows = [(f"a{i:04d}", "o", 0.0, int(rng.random() < 0.6), int(rng.random() < 0.4), round(rng.uniform(-5, 40), 2), rng.random(), rng.randrange(9))
                for i in range(n)]
        return spark.createDataFrame(rows, "account_id string, offer_id string, received_time double, treatment int, converted int,"
                                           " net_profit double, s double, z int")

    return build


@pytest.mark.parametrize("first", [0, 7, 95, 99_990])
def test_draws_equal_the_keyed_hash(spark, first):
    want = spark.range(first, first + 40).select(keyed_uniform(42, "resample", F.lit(13), "id")).collect()
    assert uniforms(42, "resample", 13, first, 40).tolist() == [r[0] for r in want]


@pytest.mark.parametrize("block, stretch, draws", [(4, 8, 50), (16, 16, 333), (8, 40, 10_000), (500, 700, 1_000)])
def test_bands_equal_those_of_all_resampled_rows(holdout, cfg, monkeypatch, block, stretch, draws):
    for name, value in (("BLOCK", block), ("STRETCH", stretch), ("DRAWS_PER_TASK", draws)):
        monkeypatch.setattr(gain, name, value)
    df, scores = holdout(90), {"a": "s", "b": "z"}
    tail = (1 - cfg.gain_curve_confidence_level) / 2
    rows = gain._resampled_curves(df, scores, cfg, 23, lambda n: None).groupBy("strategy", "n").agg(*[
        F.expr(f"percentile({c}, {q!r}) AS {c}_{side}") for c in ("gain", "conversions") for side, q in (("lo", tail), ("hi", 1 - tail))])
    want = {(r["strategy"], r["n"]): r for r in rows.collect()}
    got = gain.gain_curves_with_bands(df, scores, cfg, 23).collect()
    assert len(got) == len(want) == 2 * 91
    for r in got:
        assert [r[c] for c in rows.columns[2:]] == pytest.approx([want[r["strategy"], r["n"]][c] for c in rows.columns[2:]], abs=1e-9)


def test_no_row_is_made_per_replicate_and_point(holdout, cfg, monkeypatch):
    """The resamples were exploded, laid out, stored and shuffled as replicates x rows x strategies."""
    monkeypatch.setattr(gain, "_resampled_curves", lambda *_: pytest.fail("resampled rows"))
    stored = {}
    write = gain.written
    monkeypatch.setattr(gain, "written", lambda df, name: stored.setdefault(name, write(df, name)))
    assert gain.gain_curves_with_bands(holdout(60), {"a": "s"}, cfg, 40).count() == 61
    assert stored["resampled-blocks"].count() == 1 and stored["resampled-sums"].count() == 40 * 5


def test_an_empty_frame_has_no_bands(holdout, cfg, spark):
    assert gain.gain_curves_with_bands(holdout(3).where("s < 0"), {"a": "s"}, cfg, 3).count() == 0
