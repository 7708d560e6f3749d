"""Fits side by side don't share a thread's local properties."""

from __future__ import annotations

from functools import partial
from threading import Barrier

import pytest
from pyspark.sql import functions as F

from offertide.models import conversion
from offertide.models.effect import STAGES, EffectModel, exchanged
from offertide.models.fitting import dealt, part_sizes, together
from offertide.models.learners import TreeStage
from offertide.models.matrix import EFFECT_FEATURES, slots

from planted import planted


def test_fits_keep_their_own_local_properties(spark):
    context, both = spark.sparkContext, Barrier(2, timeout=60)

    def fit(name: str) -> str:
        context.setLocalProperty("test.fit", name)
        both.wait()
        found = context.getLocalProperty("test.fit")
        both.wait()
        return found

    assert together({n: partial(fit, n) for n in "ab"}, 2) == {"a": "a", "b": "b"}
    assert context.getLocalProperty("test.fit") is None


def test_stages_are_saved_and_loaded_side_by_side(spark, cfg):
    both = Barrier(2, timeout=20)

    class Stage:
        def save(self, path):
            both.wait()

    class Stub:
        def save(self, path):
            pass

        def load(self, path):
            return self

        def load_stage(self, spark, path):
            both.wait()
            return path

    model = EffectModel(cfg.but(fits_at_once=2), Stub())
    model._models = {"bogo": {s: Stage() for s in STAGES}}
    model.save("m")
    assert model.restore(spark, "m", ["bogo"]).models == {"bogo": {s: f"m/type=bogo/{s}" for s in STAGES}}


def test_logistic_passes_run_over_as_few_partitions_as_the_rows_need(spark, cfg, monkeypatch):
    parts, fit = [], conversion.LogisticRegression.fit
    monkeypatch.setattr(conversion.LogisticRegression, "fit",
                        lambda self, rows: parts.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    conversion.logistic_anchor(planted(spark, 200).repartition(16), cfg.but(logit_max_iter=3))
    assert parts == [1]


def test_importance_scores_only_features_in_use_by_compiled_expressions(spark, cfg, monkeypatch):
    trials, predict = [], TreeStage.predict

    def watched(self, df, name):
        if name == "guess":
            plan = df._jdf.queryExecution().executedPlan().toString()
            used = {owner for i, (_, owner) in enumerate(slots(EFFECT_FEATURES)) if self.model.featureImportances[i] > 0}
            trials.append((used, {r[0] for r in df.select("feature").distinct().collect()}, "lambda" in plan))
        return predict(self, df, name)

    monkeypatch.setattr(TreeStage, "predict", watched)
    rows = planted(spark, 600).where("offer_type <> 'informational'")
    model = EffectModel(cfg.but(effect_trees=2)).fit(rows)
    shares = model.causal_importance(rows)
    assert len(trials) == 2 and all(seen == {None, *used} and not slow for used, seen, slow in trials)
    assert set(shares) == set(EFFECT_FEATURES) and sum(shares.values()) == pytest.approx(1.0)
    assert all(shares[f] == 0 for f in set(EFFECT_FEATURES) - trials[0][0] - trials[1][0])


def test_an_exchange_takes_all_slots_of_a_feature_and_no_other(spark):
    owners = [owner for _, owner in slots(EFFECT_FEATURES)]
    n = len(owners)
    rows = spark.createDataFrame([(0.5, [float(i) for i in range(n)], [float(-i - 1) for i in range(n)])],
                                 "tau double, x array<double>, y array<double>")
    found = {r["feature"]: list(r["features"]) for r in exchanged(rows, EFFECT_FEATURES, EFFECT_FEATURES).collect()}
    assert found == {f: [float(-i - 1 if o == f else i) for i, o in enumerate(owners)] for f in (None, *EFFECT_FEATURES)}


def test_tree_passes_run_over_equal_tasks_on_all_cores(spark, cfg, monkeypatch):
    monkeypatch.setattr("offertide.models.fitting.FEW", 50, raising=False)
    parts, fit = [], conversion.GBTClassifier.fit
    monkeypatch.setattr(conversion.GBTClassifier, "fit", lambda self, rows: parts.append(
        [len(p) for p in rows.rdd.glom().collect()]) or fit(self, rows))
    conversion.ConversionModel(cfg.but(conversion_trees=1)).fit(planted(spark, 900).coalesce(1))
    assert len(parts[0]) == spark.sparkContext.defaultParallelism and max(parts[0]) - min(parts[0]) <= len(parts[0])


def test_fits_side_by_side_share_the_cores_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr("offertide.models.fitting.FEW", 50)
    rows = spark.range(900).coalesce(1)
    found = {(count, limit): [len(p) for p in dealt(rows.limit(count), [count], limit, 900).rdd.glom().collect()]
             for count, limit in ((20, 1000), (450, 1000), (900, 1000), (900, 15))}
    assert {k: len(v) for k, v in found.items()} == {(20, 1000): 1, (450, 1000): 2, (900, 1000): 4, (900, 15): 8}
    assert all(sum(v) == count and max(v) - min(v) <= len(v) for (count, _), v in found.items())


def test_rows_in_even_partitions_are_not_dealt_again(spark, monkeypatch):
    monkeypatch.setattr("offertide.models.fitting.FEW", 50)
    even = spark.range(0, 900, 1, 5)
    assert part_sizes(even.withColumn("side", F.lit("a")), "side") == {("a",): [180] * 5}
    assert dealt(even, [180] * 5, 1000) is even
    assert dealt(even, [100, 100, 100, 100, 500], 1000).rdd.getNumPartitions() == 4
