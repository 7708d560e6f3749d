"""The production model: effect plus conversion prior, blended into one ranking score."""

from __future__ import annotations

import json
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offertide.functions.storage import durable, written
from offertide.models.conversion import ConversionModel
from offertide.models.effect import EffectModel
from offertide.models.fitting import together
from offertide.models.learners import Learner
from offertide.models.matrix import EFFECT_FEATURES
from offertide.models.pairs import pair_components
from offertide.operators import quadrant, ranking, uplift_metrics
from offertide.operators.serving import ScoringGrid
from offertide.settings import GRAIN, PAID_TYPES, Settings

PAIR_COLUMNS, COMPONENTS = ("account_id", "offer_id", "offer_type"), ("uplift", "uncertainty", "p_convert")


class BlendedModel:
    def __init__(self, cfg: Settings, learner: Learner | None = None) -> None:
        self.cfg = cfg
        self.effect = EffectModel(cfg, learner)
        self.conversion = ConversionModel(cfg)

    def fit(self, train: DataFrame) -> "BlendedModel":
        together({"effect": lambda: self.effect.fit(train), "conversion": lambda: self.conversion.fit(train)}, 2)
        return self

    @classmethod
    def of(cls, effect: EffectModel, conversion: ConversionModel) -> "BlendedModel":
        """The blend of two fitted models."""
        model = cls(effect.cfg)
        model.effect, model.conversion = effect, conversion
        return model

    def components(self, df: DataFrame | ScoringGrid) -> DataFrame:
        """`df` plus uplift, uncertainty and p_convert; of a grid, every pair with its offer type and these."""
        if isinstance(df, ScoringGrid):
            found = pair_components(df, self.effect, self.conversion)
            return self.components(df.pairs()).select(*PAIR_COLUMNS, *COMPONENTS) if found is None else found
        scored = self.effect.score(df).selectExpr(*df.columns, "tau AS uplift", "uncertainty")
        return self.conversion.predict(scored)

    def score(self, df: DataFrame | ScoringGrid) -> DataFrame:
        """What `components` returns, plus `score`."""
        found = self.components(df)
        if self.cfg.blend_mode == "dynamic":
            # The scaling reads the frame twice; the models should run once.
            found = durable(found)
        return ranking.blend_score(found, self.cfg)

    def rank(self, df: DataFrame) -> DataFrame:
        """Softmax order of the score at the configured temperature."""
        return ranking.softmax_ranking(durable(self.score(df)), self.cfg.blend_temperature, self.cfg.seed)

    def effective_lambda(self, df: DataFrame) -> float:
        return float(ranking.effective_lambda(self.components(df), self.cfg).first()[0])

    def importance(self, df: DataFrame) -> DataFrame:
        """Causal, predictive and combined importance; the combination mirrors the score."""
        causal, predictive = self.effect.causal_importance(df), self.conversion.importance()
        lam = self.effective_lambda(df)
        keep = 1.0 if self.cfg.blend_mode == "fixed" else 1.0 - lam
        names = sorted(set(causal) | set(predictive))
        mixed = {f: keep * causal.get(f, 0.0) + lam * predictive.get(f, 0.0) for f in names}
        whole = sum(mixed.values()) or 1.0
        rows = [(f, causal.get(f, 0.0), predictive.get(f, 0.0), mixed[f] / whole) for f in names]
        return df.sparkSession.createDataFrame(
            rows, "feature string, uplift double, conversion double, combined double")

    def save(self, path: str, spark: SparkSession) -> None:
        kinds = sorted(self.effect.models)
        together({"effect": lambda: self.effect.save(f"{path}/effect"),
                  "conversion": lambda: self.conversion.save(f"{path}/conversion")}, 2)
        row = [(json.dumps(kinds), self.cfg.blend_mode, self.cfg.blend_lambda, self.cfg.blend_gamma,
                self.cfg.blend_temperature, self.cfg.seed)]
        spark.createDataFrame(
            row, "kinds string, blend_mode string, blend_lambda double, blend_gamma double,"
                 " blend_temperature double, seed int").write.mode("overwrite").parquet(f"{path}/parameters")

    @classmethod
    def load(cls, spark: SparkSession, cfg: Settings, path: str, learner: Learner | None = None) -> "BlendedModel":
        saved = spark.read.parquet(f"{path}/parameters").first()
        model = cls(cfg.but(
            blend_mode=saved["blend_mode"], blend_lambda=saved["blend_lambda"], blend_gamma=saved["blend_gamma"],
            blend_temperature=saved["blend_temperature"], seed=saved["seed"]), learner)
        kinds = json.loads(saved["kinds"])
        parts = together({"effect": lambda: model.effect.restore(spark, f"{path}/effect", kinds),
                          "conversion": lambda: ConversionModel.load(model.cfg, f"{path}/conversion")}, 2)
        model.conversion = parts["conversion"]
        return model


def attach_scores(frame: DataFrame | ScoringGrid, model: BlendedModel, cfg: Settings) -> DataFrame:
    """Model columns and quadrant on rows of paid types; other types keep nulls. Of a grid, every pair with its offer type and these."""
    is_paid = F.col("offer_type").isin(*PAID_TYPES)
    # Stored by column, so that the scaling and each reader read back only the columns they use.
    paid = written(model.components(frame.where(is_paid)), "paid-scores")
    scored = quadrant.add_quadrant(ranking.add_dynamic_score(paid, cfg.serving_score_gamma), cfg)
    others = frame.where(~is_paid)
    if isinstance(others, ScoringGrid):
        others = others.pairs().select(*PAIR_COLUMNS)
    return scored.unionByName(others, allowMissingColumns=True)


def placebo_scores(train: DataFrame, holdout: DataFrame, cfg: Settings, learner: Learner | None = None,
                   replicates: int | None = None) -> DataFrame:
    """Qini of effect models whose training treatment was shuffled, on the real holdout.

    Every fit is distributed; only its one score comes to the driver. The rows are put in key order
    once for all replicates, of which a few run side by side.
    """
    wanted = dict.fromkeys([*GRAIN, *EFFECT_FEATURES, "offer_type", "treatment", "converted"])
    rows = train.select(*wanted)
    slots = written(uplift_metrics.treatment_slots(rows), "placebo-slots")

    def one(i: int) -> float:
        model = EffectModel(cfg, learner).fit(uplift_metrics.shuffle_treatment(rows, cfg.seed, i, slots))
        scored = written(model.score(holdout).select(*GRAIN, "treatment", "converted", F.col("tau").alias("uplift")), "placebo-scores")
        return float(uplift_metrics.qini_auuc(scored, {"uplift": "uplift"}).first()["qini"])

    found = together({i: partial(one, i) for i in range(replicates or cfg.placebo_n_permutations)}, max(1, cfg.fits_at_once // 2))
    return train.sparkSession.createDataFrame(sorted(found.items()), "replicate int, qini double")
