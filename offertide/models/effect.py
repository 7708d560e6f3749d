"""X-learner of the effect of seeing an offer, one per offer type (Kuenzel et al. 2019).

mu0 and mu1 predict conversion from the control and the treated rows. The treated rows
then give `converted - mu0`, the control rows `mu1 - converted`, and one model is fitted
to each. With p the share of treated rows of the scored type, the effect is
p * tau_c + (1 - p) * tau_t and its uncertainty |tau_t - tau_c|.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offertide.functions.draws import keyed_uniform
from offertide.functions.ranked import numbered
from offertide.functions.storage import durable, written
from offertide.models.fitting import dealt, part_sizes, together
from offertide.models.learners import Fitted, Learner, TreeLearner
from offertide.models.matrix import EFFECT_FEATURES, slots
from offertide.settings import GRAIN, Settings

STAGES = ("mu0", "mu1", "tau_t", "tau_c")


def fixed_propensity(df: DataFrame) -> DataFrame:
    """Mean treatment per type of the given frame; 0.5 where only one arm is present."""
    return df.groupBy("offer_type").agg(F.avg("treatment").alias("rate")).selectExpr(
        "offer_type", "IF(rate > 0 AND rate < 1, rate, 0.5D) AS propensity")


class EffectModel:
    def __init__(self, cfg: Settings, learner: Learner | None = None) -> None:
        self.cfg = cfg
        self.learner = learner or TreeLearner(cfg)
        self._models: dict[str, dict[str, Fitted]] | None = None

    def fit(self, train: DataFrame) -> "EffectModel":
        """Both outcome models of all types are fitted side by side, then both effect models."""
        self.learner = self.learner.prepare(train)
        size, threads = self.cfg.tree_rows_per_task, self.cfg.fits_at_once
        shaped = written(self.learner.shape(train.select(*GRAIN, *EFFECT_FEATURES, "offer_type", "treatment", "converted"))
                         .select("offer_type", "treatment", "converted", *self.learner.inputs), "fit-rows")
        arms = part_sizes(shaped, "offer_type", "treatment")
        kinds = sorted({kind for kind, _ in arms})
        for kind in kinds:
            if {t for k, t in arms if k == kind} != {0, 1}:
                raise ValueError(f"offer type {kind!r} has only one arm in the training rows")
        everything = sum(map(sum, arms.values()))

        def rows(kind: str, treatment: int) -> DataFrame:
            return shaped.where((F.col("offer_type") == kind) & (F.col("treatment") == treatment))

        def fitted(stored: DataFrame, sizes: list[int], target: str) -> Fitted:
            return self.learner.fit(dealt(stored, sizes, size, everything), target)

        def outcome(kind: str, treatment: int) -> Fitted:
            return fitted(rows(kind, treatment), arms[kind, treatment], "converted")

        def effect(kind: str, treatment: int) -> Fitted:
            # The effect of the arm in sight, by the outcome model of the other arm, stored before the fit reads it.
            other = outcomes[kind, 1 - treatment].predict(rows(kind, treatment), "m")
            sign = 1 if treatment else -1
            target = other.withColumn("d", sign * (F.col("converted") - F.col("m"))).drop("m")
            stored = written(target, "effect-rows")
            return fitted(stored, part_sizes(stored)[()], "d")

        cells = [(k, t) for k in kinds for t in (0, 1)]
        outcomes = together({c: partial(outcome, *c) for c in cells}, threads)
        effects = together({c: partial(effect, *c) for c in cells}, threads)
        self._models = {k: {"mu0": outcomes[k, 0], "mu1": outcomes[k, 1], "tau_t": effects[k, 1], "tau_c": effects[k, 0]}
                        for k in kinds}
        return self

    @property
    def models(self) -> dict[str, dict[str, Fitted]]:
        if self._models is None:
            raise RuntimeError("the effect model is not fitted")
        return self._models

    def shares(self, df: DataFrame) -> dict[str, float]:
        """The propensity of each offer type of `df`, all of which must have models."""
        found = {r["offer_type"]: r["propensity"] for r in fixed_propensity(df).collect()}
        unknown = set(found) - set(self.models)
        if unknown:
            raise ValueError(f"no model for offer types {sorted(unknown)}")
        return found

    def score(self, df: DataFrame) -> DataFrame:
        """`df` plus mu0, mu1, tau_t, tau_c, tau and uncertainty, joined to nothing."""
        parts = []
        for kind, p in sorted(self.shares(df).items()):
            rows = self.learner.shape(df.where(F.col("offer_type") == kind))
            for stage in STAGES:
                rows = self.models[kind][stage].predict(rows, stage)
            parts.append(rows.selectExpr(
                *df.columns, *STAGES, f"{p!r}D * tau_c + {1 - p!r}D * tau_t AS tau",
                "abs(tau_t - tau_c) AS uncertainty"))
        if not parts:
            empty = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in (*STAGES, "tau", "uncertainty"))
            return df.selectExpr("*", *empty.split(", "))
        return reduce(DataFrame.unionByName, parts)

    def predict(self, df: DataFrame) -> DataFrame:
        return self.score(df).select(*GRAIN, "offer_type", F.col("tau").alias("uplift"))

    def predict_stages(self, df: DataFrame) -> DataFrame:
        return self.score(df).select(*GRAIN, "offer_type", "mu0", "mu1", "tau")

    def predict_uncertainty(self, df: DataFrame) -> DataFrame:
        return self.score(df).select(*GRAIN, "offer_type", "uncertainty")

    def causal_importance(self, df: DataFrame) -> dict[str, float]:
        """Share of each feature in explaining the estimated effect.

        Per type a surrogate learns tau from the features; a feature's importance is the
        rise of its squared error when the feature is taken from another row of the type
        instead, relative to the variance of tau. All features are measured in one pass:
        every row is scored once per feature that the surrogate uses, with only that feature
        exchanged. Types are measured side by side.
        """
        if not isinstance(self.learner, TreeLearner):
            raise TypeError("causal importance needs the tree learner")
        totals, weight = dict.fromkeys(EFFECT_FEATURES, 0.0), 0
        scored = durable(self.learner.shape(self.score(df)).select(
            *GRAIN, "offer_type", "tau", "features", vector_to_array("features").alias("x")))
        sizes = {kind: own for (kind,), own in part_sizes(scored, "offer_type").items()}
        everything = sum(map(sum, sizes.values()))

        def measured(kind: str) -> tuple[dict[str, float], int]:
            rows = scored.where(F.col("offer_type") == kind)
            surrogate = self.learner.fit(
                dealt(rows.select("features", "tau"), sizes[kind], self.cfg.tree_rows_per_task, everything), "tau")
            keys = [F.asc(k) for k in GRAIN]
            taker = numbered(rows.select(*GRAIN, "tau", "x"), keys, name="place", sized=True)
            giver = numbered(
                rows.select(*GRAIN, F.col("x").alias("y"),
                            keyed_uniform(self.cfg.seed, "importance", *GRAIN).alias("u")),
                [F.asc("u"), *keys], name="place", sized=True).select("place", "y")
            # A feature in no split of the surrogate can't change its error.
            used = sorted({owners[i] for i in surrogate.used_slots()}, key=EFFECT_FEATURES.index)
            trials = exchanged(taker.join(giver, "place"), EFFECT_FEATURES, used)
            errors = {r["feature"]: (r["mse"], r["spread"], r["n"]) for r in surrogate.predict(trials, "guess")
                      .groupBy("feature").agg(F.expr("avg(power(tau - guess, 2)) AS mse"),
                                              F.expr("var_pop(tau) AS spread"), F.expr("count(1) AS n")).collect()}
            base, spread, n = errors[None]
            return {f: max((errors[f][0] - base) / spread if spread else 0.0, 0.0) for f in used}, n

        owners = [owner for _, owner in slots(EFFECT_FEATURES)]
        for rises, n in together({k: partial(measured, k) for k in sorted(sizes)}, self.cfg.fits_at_once).values():
            for feature, rise in rises.items():
                totals[feature] += rise * n
            weight += n
        means = {f: v / weight for f, v in totals.items()} if weight else totals
        whole = sum(means.values())
        return {f: v / whole if whole > 0 else v for f, v in means.items()}

    def save(self, path: str) -> None:
        models = self.models
        self.learner.save(path)
        together({(k, s): partial(fitted.save, f"{path}/type={k}/{s}") for k, stages in models.items()
                  for s, fitted in stages.items()}, self.cfg.fits_at_once)

    def restore(self, spark, path: str, kinds: list[str]) -> "EffectModel":
        self.learner = self.learner.load(path)
        loaded = together({(k, s): partial(self.learner.load_stage, spark, f"{path}/type={k}/{s}") for k in kinds
                           for s in STAGES}, self.cfg.fits_at_once)
        self._models = {k: {s: loaded[k, s] for s in STAGES} for k in kinds}
        return self


def exchanged(rows: DataFrame, features: Sequence[str], wanted: Sequence[str]) -> DataFrame:
    """Per row of `rows` (tau and the slot arrays x and y): x as it is (`feature` null), and once per wanted
    feature with that feature's slots taken from y.

    The slots of a feature stand side by side, so an exchange is three slices, which are compiled.
    """
    owners = [owner for _, owner in slots(tuple(features))]
    cuts = [("CAST(NULL AS STRING)", 0, 0), *[(f"'{f}'", owners.index(f), owners.count(f)) for f in wanted]]
    listed = ", ".join(f"struct({name} AS feature, {start} AS start, {width} AS width)" for name, start, width in cuts)
    size = len(owners)
    return rows.selectExpr("tau", "x", "y", f"inline(array({listed}))").select("feature", "tau", array_to_vector(F.expr(
        f"concat(slice(x, 1, start), slice(y, start + 1, width), slice(x, start + width + 1, {size}))")).alias("features"))


def stage_diagnostics(scored: DataFrame) -> DataFrame:
    """Mean and population spread of mu0 and mu1, their gap and the mean effect per type."""
    return scored.groupBy("offer_type").agg(
        F.expr("avg(mu0) AS mu0_mean"), F.expr("stddev_pop(mu0) AS mu0_std"),
        F.expr("avg(mu1) AS mu1_mean"), F.expr("stddev_pop(mu1) AS mu1_std"),
        F.expr("avg(mu1) - avg(mu0) AS mu1_minus_mu0"), F.expr("avg(tau) AS tau_mean"))
