"""The staged tables that the registered queries share, per session and data folder.

The log and the processed table are written once as Parquet in the shared folder,
as the preparation job would leave them, and read back by every later query.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from offertide.functions.storage import small_or_same, written
from offertide.models.blended import BlendedModel
from offertide.models.conversion import ConversionModel
from offertide.models.effect import EffectModel
from offertide.models.fitting import together
from offertide.models.learners import CellMeanLearner
from offertide.operators import clean, quadrant, ranking, segments, serving
from offertide.operators.attribution import with_validity
from offertide.plans import processed as prep
from offertide.sources import testbed
from offertide.sources.files import parse_events

_KNOWN: dict[tuple[str, str], "Workspace"] = {}


def workspace(spark: SparkSession, folder: str) -> "Workspace":
    key = (spark.sparkContext.applicationId, str(folder))
    if key not in _KNOWN:
        _KNOWN[key] = Workspace(spark, str(folder))
    return _KNOWN[key]


class Workspace:
    cfg = testbed.SETTINGS

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    @cached_property
    def offers(self) -> DataFrame:
        return testbed.raw_offers(self.spark, self.folder)

    @cached_property
    def active(self) -> DataFrame:
        """Offers that the log shows as sent: what the scoring grid crosses with the customers."""
        return small_or_same(serving.sent_offers(self.offers, clean.receipts(self.log)), self.cfg.small_table_rows)[0]

    @property
    def raw_events(self) -> DataFrame:
        return testbed.raw_events(self.spark, self.folder)

    @property
    def raw_profile(self) -> DataFrame:
        return testbed.raw_profile(self.spark, self.folder)

    @property
    def profile(self) -> DataFrame:
        return clean.normalize_profile(self.raw_profile, self.cfg)

    @cached_property
    def log(self) -> DataFrame:
        return prep.stage_log(parse_events(self.raw_events))

    @cached_property
    def hot(self):
        return prep.hot_accounts(self.log, self.cfg)

    @property
    def received(self) -> DataFrame:
        return with_validity(clean.receipts(self.log), self.offers)

    @cached_property
    def assembled(self) -> DataFrame:
        """Every stage column, before the projection to the contract."""
        return written(
            prep.assemble(self.log, self.offers, self.profile, self.cfg, self.hot), "assembled"
        )

    @property
    def attributed(self) -> DataFrame:
        from offertide.operators.attribution import ATTRIBUTED_COLUMNS

        return self.assembled.select(*ATTRIBUTED_COLUMNS)

    @property
    def processed(self) -> DataFrame:
        from offertide.operators.contract import enforce_schema

        return enforce_schema(self.assembled)

    @property
    def split(self) -> tuple[DataFrame, DataFrame]:
        """(training, holdout) rows of paid types."""
        train, holdout = clean.temporal_split(clean.paid_types_only(self.processed), self.cfg)
        return train, holdout

    @cached_property
    def scored(self) -> DataFrame:
        """Holdout with score columns that are plain formulas of its features."""
        _, holdout = self.split
        return written(with_formula_scores(clean.add_net_profit(holdout)), "scored")


    @cached_property
    def serving_grid(self) -> serving.ScoringGrid:
        at = serving.decision_time(self.log).first()[0]
        return serving.scoring_grid(
            self.log, self.offers, self.profile, at, self.cfg, self.active, hot=self.hot)

    @cached_property
    def serving_frame(self) -> DataFrame:
        return self.serving_grid.pairs()

    @cached_property
    def matrix(self) -> DataFrame:
        """Serving rows with formula scores; other types keep null scores. Computed from the stored customers by each reader."""
        frame = self.serving_frame
        paid = quadrant.add_quadrant(
            ranking.add_dynamic_score(with_formula_scores(clean.paid_types_only(frame)), 1.0), self.cfg)
        keep = ["account_id", "offer_id", "offer_type"]
        scores = ["uplift", "p_convert", "uncertainty", "score_dynamic", "quadrant"]
        others = frame.where("offer_type NOT IN ('bogo', 'discount')").select(*keep)
        return paid.select(*keep, *scores).unionByName(others, allowMissingColumns=True)

    @cached_property
    def scored_holdout(self) -> DataFrame:
        """Holdout with formula scores, dynamic score, quadrant and random score."""
        scored = ranking.add_dynamic_score(self.scored, 1.0)
        return written(
            serving.add_hash_score(quadrant.add_quadrant(scored, self.cfg), self.cfg.seed), "scored-holdout")

    @cached_property
    def cell_effect(self) -> EffectModel:
        train, _ = self.split
        return EffectModel(self.cfg, CellMeanLearner(CELL_CONDITIONS, self.cfg)).fit(train)

    @cached_property
    def effect(self) -> EffectModel:
        return EffectModel(self.cfg).fit(self.split[0])

    @cached_property
    def conversion(self) -> ConversionModel:
        return ConversionModel(self.cfg).fit(self.split[0])

    @cached_property
    def blended(self) -> BlendedModel:
        """Both models, fitted side by side unless an earlier query has them."""
        self.split  # noqa: B018 - the shared tables first
        models = together({"effect": lambda: self.effect, "conversion": lambda: self.conversion}, 2)
        return BlendedModel.of(models["effect"], models["conversion"])

    @property
    def clients(self) -> DataFrame:
        return segments.client_features(self.processed, self.log)


CELL_CONDITIONS = ("hist_txn_count >= 4", "min_value >= 15", "hist_offers_viewed >= 1")

# Simple stand-ins for model output, so that ranking and evaluation can be checked
# exactly: rounded, with ties among customers without history.
FORMULA_SCORES = {
    "uplift": "round(0.1 * (hist_avg_ticket / 50 - 1) + 0.02 * hist_offers_viewed"
              " - 0.001 * n_concurrent_offers, 9)",
    "p_convert": "round(1 / (1 + exp(1 - 0.002 * hist_spend_total - 0.05 * duration)), 9)",
    "uncertainty": "round(abs(hist_spend_trend) / 100 + 0.01 * duration, 9)",
}


def with_formula_scores(df: DataFrame) -> DataFrame:
    return df.selectExpr("*", *[f"{sql} AS {name}" for name, sql in FORMULA_SCORES.items()])
