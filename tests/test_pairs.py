from __future__ import annotations

import os
import subprocess
import sys
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from offertide.arrays.pairs import PairForest, PairScores, packed, read_trees
from offertide.models import blended, pairs
from offertide.models.learners import CellMeanLearner
from offertide.operators import clean, contract, serving
from offertide.plans import jobs
from offertide.settings import Settings

from planted import planted

CFG = Settings(effect_trees=7, effect_depth=5, conversion_trees=9, conversion_depth=4, conversion_step=0.2, effect_step=0.3, tree_min_rows=3)


def varied(spark, n):
    """Planted rows whose terms and genders differ."""
    terms = {"duration": "3D + abs(hash(account_id)) % 8", "min_value": "10D + abs(hash(offer_id, account_id)) % 4",
             "gender": "element_at(array('F', 'M', 'O', 'unknown'), 1 + CAST(abs(hash(account_id, 1)) % 4 AS INT))"}
    return planted(spark, n).withColumns({name: F.expr(sql) for name, sql in terms.items()})


@pytest.fixture(scope="module")
def model(spark):
    train, _ = clean.temporal_split(clean.paid_types_only(varied(spark, 3000)), CFG)
    return blended.BlendedModel(CFG).fit(train)


@pytest.fixture(scope="module")
def grid(spark):
    """Customers and offers of many planted rows, each row cut in two."""
    rows = varied(spark, 60).withColumn("gender", F.expr("IF(account_id < 'c00005', 'new', gender)"))
    per_offer = ["offer_id", "offer_type", "treatment", "converted", "conversion_value", "is_recurrent", "campaign_wave", "reward_cost",
                 "n_concurrent_offers", *contract.COLUMNS[contract.COLUMNS.index("discount_value"):-1]]
    rows = rows.withColumns({"treatment": F.lit(1), "offer_id": F.concat("offer_id", F.lit("/"), "account_id")})
    customers = rows.select(*[c for c in contract.COLUMNS if c not in per_offer])
    offers = spark.createDataFrame(rows.select(*per_offer).limit(23).toArrow())
    return serving.ScoringGrid(customers.cache(), offers, True, 300)


def test_trees_of_a_description_reach_their_leaves():
    text = """GBTRegressionModel: uid=x, numTrees=2, numFeatures=3
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 2 in {0.0,2.0})
      Predict: 1.0
     Else (feature 2 not in {0.0,2.0})
      Predict: 2.0
    Else (feature 0 > 0.5)
     If (feature 1 <= -1.5E-3)
      Predict: 4.0
     Else (feature 1 > -1.5E-3)
      Predict: 8.0
  Tree 1 (weight 0.1):
    Predict: 100.0
"""
    left, right = [(a, b) for a in (0.5, 0.6, float("nan")) for b in (-0.0015, 0.0)], [0.0, 1.0, 2.0]
    forest = PairForest(read_trees(text), [0, 1], [2], np.array([[0, 0, c] for c in right]))
    want = [[10 + ((1 if c in (0, 2) else 2) if a <= 0.5 else 4 if b <= -0.0015 else 8) for c in right] for a, b in left]
    assert forest.sums(np.array([[a, b, 0] for a, b in left]).T).tolist() == want


def test_pairs_score_as_their_rows(model, grid):
    keys = ["account_id", "offer_id"]
    paid = grid.where(F.col("offer_type") != "informational")
    assert pairs.pair_components(paid, model.effect, model.conversion) is not None
    read = [i for trees in (model.conversion.trees, model.effect.models["bogo"]["tau_t"].model) for i in trees.featureImportances.indices]
    assert len(set(read)) > 8  # slots of either side
    found = {(r[0], r[1]): r for r in model.components(paid).collect()}
    rows = model.components(paid.pairs()).select(*keys, "offer_type", "uplift", "uncertainty", "p_convert").collect()
    assert len(found) == len(rows) == 60 * paid.offers.count() and len({r["uplift"] for r in rows}) > 50
    for r in rows:
        other = found[r[0], r[1]]
        assert other["offer_type"] == r["offer_type"]
        assert [other[c] for c in blended.COMPONENTS] == pytest.approx([r[c] for c in blended.COMPONENTS], abs=1e-12)


def test_no_tree_is_read_once_per_pair(model, grid):
    """The models' functions ran on each pair, so their time grew with customers times offers."""
    paid = grid.where(F.col("offer_type") != "informational")
    plan = model.score(paid)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "predict" not in plan.lower() and "Probability" not in plan


def test_scores_are_unpacked_without_this_package():
    scores = PairScores(["o"], ["bogo"], [], PairForest(read_trees("  Tree 0 (weight 1.0):\n    Predict: 2.0\n"), [0], [1], np.zeros((1, 2))))
    code = "import pickle, sys, numpy; print(pickle.load(sys.stdin.buffer).conversion.sums(numpy.zeros((2, 1))).tolist(), 'offertide' in sys.modules)"
    out = subprocess.run([sys.executable, "-c", code], input=packed(scores), capture_output=True, cwd="/", check=True,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.stdout.decode().split() == ["[[2.0]]", "False"]


def test_attached_scores_of_a_grid_keep_every_pair(model, grid):
    out = blended.attach_scores(grid, model, CFG)
    rows = {(r["account_id"], r["offer_id"]): r for r in out.collect()}
    assert len(rows) == 60 * 23
    for r in blended.attach_scores(grid.pairs(), model, CFG).collect():
        other = rows[r["account_id"], r["offer_id"]]
        assert other["quadrant"] == r["quadrant"] and (r["score_dynamic"] is None) == (r["offer_type"] == "informational")
        assert other["score_dynamic"] == (None if r["score_dynamic"] is None else pytest.approx(r["score_dynamic"], abs=1e-9))


def test_other_learners_and_large_catalogues_score_rows(spark, model, grid, monkeypatch):
    paid = grid.where(F.col("offer_type") != "informational")
    large = serving.ScoringGrid(paid.customers, paid.offers, False, 300)
    assert pairs.pair_components(large, model.effect, model.conversion) is None
    assert model.components(large).columns == model.components(paid).columns
    assert model.components(large).count() == 60 * paid.offers.count()
    cells = blended.BlendedModel.of(blended.EffectModel(CFG, CellMeanLearner(["hist_txn_count > 3"], CFG)), model.conversion)
    assert pairs.pair_components(paid, cells.effect, cells.conversion) is None
    monkeypatch.setattr("offertide.arrays.pairs.MOST_LEAVES", 2)
    assert pairs.pair_components(paid, model.effect, model.conversion) is None


def test_offers_without_a_model_are_refused(model, grid):
    with pytest.raises(ValueError, match="no model for offer types"):
        model.components(grid)


@pytest.fixture
def raw(spark, model, make_events, make_offers, monkeypatch):
    """The jobs' raw tables and fitted model, and the grids that were scored without forming their rows."""
    log = make_events(*[(f"c{i}", "offer received", 5.0, f"o{i % 3}") for i in range(9)], *[(f"c{i}", "transaction", 6.0 + i, None, 9.0) for i in range(9)])
    offers = make_offers(("o0", "bogo", 10, 5, 7), ("o1", "discount", 12, 2, 5), ("o2", "informational", 0, 0, 4))
    profile = spark.createDataFrame([(f"c{i}", 30 + i, "F", 9.0, 0, 5) for i in range(9)],
                                    "account_id string, age int, gender string, credit_card_limit double, identity_missing int, tenure_days int")
    scored = []
    monkeypatch.setattr(jobs, "_raw", lambda *_: (offers, profile, log))
    monkeypatch.setattr(blended.BlendedModel, "load", lambda *_: model)
    monkeypatch.setattr(blended, "pair_components", lambda *given: scored.append(pairs.pair_components(*given)) or scored[-1])
    return scored


def test_recommending_scores_pairs(spark, raw):
    assert jobs.recommend(spark, "", "", CFG, 4).count() == 4
    assert [found.count() for found in raw] == [18]


def test_publishing_scores_pairs(spark, raw, tmp_path):
    varied(spark, 120).write.parquet(str(tmp_path / "processed"))
    tables = jobs.publish(spark, "", str(tmp_path / "processed"), "", str(tmp_path / "site"), CFG)
    assert tables["matrix"].count() == 27 and tables["matrix"].where("uplift IS NULL").count() == 9
    assert [found.count() for found in raw] == [18]


def test_the_model_is_loaded_while_the_log_is_staged(spark, model, raw, monkeypatch):
    """One waited for the other, with most cores idle."""
    both = threading.Barrier(2, timeout=20)
    staged, load = jobs._raw, blended.BlendedModel.load
    monkeypatch.setattr(jobs, "_raw", lambda *a: both.wait() is None or staged(*a))
    monkeypatch.setattr(blended.BlendedModel, "load", lambda *a: both.wait() is None or load(*a))
    assert jobs.recommend(spark, "", "", CFG, 3).count() == 3
