"""The four jobs, as importable functions for spark-submit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offertide.functions.storage import small_or_same, written
from offertide.models.blended import BlendedModel, attach_scores
from offertide.models.fitting import together
from offertide.models.learners import Learner
from offertide.operators import clean, contract, quality, serving
from offertide.plans import history
from offertide.plans.processed import build_processed, hot_accounts, stage_log
from offertide.settings import Settings
from offertide.sources import files

OFFERS, PROFILE, EVENTS, PROCESSED = "offers", "profile", "events", "processed"


def _raw(spark: SparkSession, folder: str, cfg: Settings, multi_line: bool, store: str | None = None):
    offers = small_or_same(files.read_offers(spark, f"{folder}/{OFFERS}", multi_line), cfg.small_table_rows)[0]
    profile = clean.normalize_profile(files.read_profile(spark, f"{folder}/{PROFILE}", multi_line), cfg)

    def parsed(path: str | list[str]) -> DataFrame:
        return files.parse_events(files.read_events(spark, path, multi_line))

    if store is None:
        log = stage_log(parsed(f"{folder}/{EVENTS}"))
    else:
        history.refresh(spark, f"{folder}/{EVENTS}", store, parsed)
        log = history.staged(spark, store, files.FLAT_SCHEMA)
    return offers, profile, log


def prepare(spark: SparkSession, raw_folder: str, out: str, cfg: Settings, multi_line: bool = False) -> DataFrame:
    """Raw JSON to the validated processed table."""
    offers, profile, log = _raw(spark, raw_folder, cfg, multi_line)
    built = written(build_processed(log, offers, profile, cfg, hot_accounts(log, cfg)), PROCESSED)
    contract.check_schema(built, strict=True)
    quality.unexpected_nulls(built, strict=True)
    quality.require_clean(quality.value_domains(built))
    files.write_processed(built, out)
    return files.read_processed(spark, out)


def train(spark: SparkSession, processed_path: str, model_path: str, cfg: Settings,
          learner: Learner | None = None) -> BlendedModel:
    """Fit on the training waves of paid types and save."""
    processed = files.read_processed(spark, processed_path)
    rows, _ = clean.temporal_split(processed, cfg)
    model = BlendedModel(cfg, learner).fit(clean.paid_types_only(rows))
    model.save(model_path, spark)
    return model


def recommend(spark: SparkSession, raw_folder: str, model_path: str, cfg: Settings, budget: int | None = None,
              decision_time: float | None = None, out: str | None = None, multi_line: bool = False,
              learner: Learner | None = None, store: str | None = None) -> DataFrame:
    """Best offer for the best customers within the budget; optionally as CSV.

    With a `store`, the staged log is kept there, and later calls parse only new raw files.
    """

    def staged() -> serving.ScoringGrid:
        offers, profile, log = _raw(spark, raw_folder, cfg, multi_line, store)
        at = serving.decision_time(log, decision_time).first()[0]
        active = small_or_same(serving.paid_offers(serving.sent_offers(offers, clean.receipts(log))), cfg.small_table_rows)[0]
        return serving.scoring_grid(log, offers, profile, at, cfg, active, hot=hot_accounts(log, cfg))

    # The model is many small files, so it is loaded while the log is staged.
    parts = together({"model": lambda: BlendedModel.load(spark, cfg, model_path, learner), "grid": staged}, 2)
    model, grid = parts["model"], parts["grid"]
    scored = written(model.score(grid).select("account_id", "offer_id", "offer_type", "score"), "scores")
    chosen = serving.recommend(scored, budget or cfg.predict_budget, model.cfg.blend_temperature, model.cfg.seed)
    if out:
        files.write_recommendations(chosen, out)
    return chosen


def publish(spark: SparkSession, raw_folder: str, processed_path: str, model_path: str, out: str, cfg: Settings,
            multi_line: bool = False, learner: Learner | None = None, store: str | None = None) -> dict[str, DataFrame]:
    """Serving matrix, labelled scored holdout, catalogue and scalar metadata as Parquet; `store` as in `recommend`."""

    def staged() -> tuple[DataFrame, float, serving.ScoringGrid]:
        offers, profile, log = _raw(spark, raw_folder, cfg, multi_line, store)
        at = serving.decision_time(log).first()[0]
        active = small_or_same(serving.sent_offers(offers, clean.receipts(log)), cfg.small_table_rows)[0]
        return offers, at, serving.scoring_grid(log, offers, profile, at, cfg, active, hot=hot_accounts(log, cfg))

    parts = together({"model": lambda: BlendedModel.load(spark, cfg, model_path, learner), "staged": staged}, 2)
    model, (offers, at, grid) = parts["model"], parts["staged"]

    def scored_grid() -> DataFrame:
        return written(attach_scores(grid, model, cfg).select(
            "account_id", "offer_id", "offer_type", "uplift", "p_convert", "uncertainty", "score_dynamic", "quadrant"), "matrix")

    def scored_holdout() -> DataFrame:
        _, held = clean.temporal_split(files.read_processed(spark, processed_path), cfg)
        paid = clean.add_net_profit(clean.paid_types_only(held))
        return written(serving.add_hash_score(attach_scores(paid, model, cfg), cfg.seed), "holdout")

    scored = together({"matrix": scored_grid, "holdout": scored_holdout}, 2)
    matrix, holdout = scored["matrix"], scored["holdout"]
    metadata = (
        serving.conversion_means(holdout)
        .crossJoin(matrix.agg(F.expr("count(DISTINCT account_id) AS n_clients"), F.expr("count(1) AS n_rows")))
        .crossJoin(holdout.agg(F.expr("count(1) AS n_holdout_rows")))
        .selectExpr(
            f"{float(at)!r}D AS decision_time", "*", f"{cfg.seed} AS seed",
            f"{cfg.serving_default_budget} AS default_budget",
            f"{cfg.serving_temperature_default!r}D AS temperature_default",
            f"{cfg.serving_temperature_max!r}D AS temperature_max"))
    tables = {
        "matrix": matrix,
        "holdout": holdout.select("account_id", "offer_type", "treatment", "converted", "net_profit",
                                  "score_random", "p_convert", "score_dynamic", "quadrant"),
        "offers": offers.selectExpr("id AS offer_id", "offer_type", "discount_value", "min_value", "duration"),
        "metadata": metadata,
    }
    files.write_scored_tables(tables, out)
    return {name: spark.read.parquet(f"{out}/{name}") for name in tables}
