"""The production model's components for every pair of the scoring grid."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offertide.arrays.pairs import Group, PairForest, PairScores, packed, read_trees, scorer
from offertide.functions.storage import small_or_same
from offertide.models.conversion import ConversionModel
from offertide.models.effect import EffectModel
from offertide.models.learners import TreeLearner
from offertide.models.matrix import EFFECT_FEATURES, FEATURES, slots
from offertide.operators.contract import enforce_schema
from offertide.operators.serving import ScoringGrid


def pair_components(grid: ScoringGrid, effect: EffectModel, conversion: ConversionModel) -> DataFrame | None:
    """account_id, offer_id, offer_type, uplift, uncertainty and p_convert of every pair.

    Vectors are made once per customer and once per offer, and each tree is read once per customer. None where that
    doesn't apply: another learner, deep trees, a catalogue too large for the driver, or no pair.
    """
    if not isinstance(effect.learner, TreeLearner) or not grid.small:
        return None
    texts = {(k, s): effect.models[k][s].model.toDebugString for k in effect.models for s in ("tau_t", "tau_c")}
    trees = {name: read_trees(text) for name, text in texts.items()}
    prior = read_trees(conversion.trees.toDebugString)
    customer, offer = (small_or_same(side.limit(1), 1)[0] for side in (grid.customers, grid.offers))

    def vectors(pairs: DataFrame) -> DataFrame:
        shaped = effect.learner.shape(enforce_schema(pairs)).withColumnRenamed("features", "effect")
        return conversion.matrix.transform(shaped).select(
            "account_id", "offer_id", "offer_type", "treatment", vector_to_array("effect").alias("effect"),
            vector_to_array("features").alias("conversion"))

    offers = vectors(customer.crossJoin(grid.offers))
    rows = offers.collect()  # as many as the catalogue, which is small
    if not rows or prior is None or None in trees.values():
        return None
    shares = effect.shares(offers)

    def side(features: tuple[str, ...], columns: list[str]) -> list[int]:
        return [i for i, (_, owner) in enumerate(slots(features)) if owner in columns]

    def forest(found: list, features: tuple[str, ...], x: np.ndarray) -> PairForest:
        return PairForest(found, side(features, grid.customers.columns), side(features, grid.offers.columns), x)

    own, every = np.array([r["effect"] for r in rows]), np.array([r["conversion"] for r in rows])
    groups = []
    for kind, p in sorted(shares.items()):
        places = np.array([i for i, r in enumerate(rows) if r["offer_type"] == kind])
        groups.append(Group(places, p, *[forest(trees[kind, s], EFFECT_FEATURES, own[places]) for s in ("tau_t", "tau_c")]))
    scores = PairScores([r["offer_id"] for r in rows], [r["offer_type"] for r in rows], groups, forest(prior, FEATURES, every))
    held = offers.sparkSession.sparkContext.broadcast(packed(scores))
    return vectors(grid.dealt().crossJoin(offer)).select("account_id", "effect", "conversion").mapInArrow(
        scorer(held), "account_id string, offer_id string, offer_type string, uplift double, uncertainty double, p_convert double")
