"""Customer frame, standardised matrix, K-Means segments and personas."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import partial

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offertide.functions.joins import keyed_join
from offertide.functions.timeline import HotKeys
from offertide.models.fitting import laid_out, together
from offertide.settings import BOUGHT, Settings

LOG_FEATURES = ("spend_total", "txn_count", "avg_ticket")
MISSING = "missing identity"
PROFILE_FEATURES = ("age", "credit_card_limit", "tenure_days", "spend_total", "txn_count", "avg_ticket")
PROFILE_MEANS = (*PROFILE_FEATURES, "offers_received", "view_rate", "conv_rate", "margin")

# Fixed names of the personas.
BASE, HIGH, LOW, MID, UNREGISTERED = (
    "Base", "High value", "Low ticket", "Mid value", "Incomplete registration")


def client_features(processed: DataFrame, events: DataFrame) -> DataFrame:
    """One row per customer over the whole period: descriptive, never a model input."""
    people = processed.groupBy("account_id").agg(
        *[F.expr(f"max({c}) AS {c}") for c in ("age", "credit_card_limit", "tenure_days", "identity_missing", "gender")],
        F.expr("count(1) AS offers_received"), F.expr("sum(treatment) AS offers_viewed"),
        F.expr("sum(converted) AS conversions"), F.expr("sum(conversion_value) AS conversion_value"),
        F.expr("sum(reward_cost) AS reward_cost"))
    spend = events.where(F.col("event") == BOUGHT).groupBy("account_id").agg(
        F.expr("sum(amount) AS spend"), F.expr("count(1) AS bought"))
    return people.join(spend, "account_id", "left").selectExpr(
        *people.columns, "coalesce(spend, 0D) AS spend_total", "coalesce(bought, 0L) AS txn_count",
        "IF(bought > 0, spend / bought, 0D) AS avg_ticket",
        "offers_viewed / offers_received AS view_rate", "conversions / offers_received AS conv_rate",
        "conversion_value - reward_cost AS margin")


@dataclass(frozen=True)
class Design:
    """Standardised features per customer and what is needed to undo the scaling."""

    frame: DataFrame
    columns: tuple[str, ...]
    means: dict[str, float]
    stds: dict[str, float]

    def vectors(self) -> DataFrame:
        return VectorAssembler(inputCols=list(self.columns), outputCol="features").transform(self.frame)


def design_matrix(clients: DataFrame, cfg: Settings) -> Design:
    """Complete profiles only; log1p on money and counts, then population z-scores."""
    columns = tuple(cfg.cluster_features)
    shaped = clients.where("identity_missing = 0").selectExpr("account_id", *[
        f"ln(1 + CAST({c} AS DOUBLE)) AS {c}" if c in LOG_FEATURES else f"CAST({c} AS DOUBLE) AS {c}" for c in columns])
    stats = shaped.agg(*[
        F.expr(f"struct(avg({c}) AS mean, stddev_pop({c}) AS std, count_if({c} IS NULL) AS nulls) AS {c}")
        for c in columns]).first()
    empty = [c for c in columns if stats[c]["nulls"]]
    if empty:
        raise ValueError(f"null in a complete profile: {empty}")
    constant = [c for c in columns if not stats[c]["std"]]
    if constant:
        raise ValueError(f"constant feature cannot be standardised: {constant}")
    means = {c: stats[c]["mean"] for c in columns}
    stds = {c: stats[c]["std"] for c in columns}
    scaled = shaped.selectExpr("account_id", *[f"({c} - {means[c]!r}D) / {stds[c]!r}D AS {c}" for c in columns])
    return Design(scaled, columns, means, stds)


@dataclass(frozen=True)
class Clusters:
    """A fitted K-Means whose clusters are numbered by their centres, not by chance."""

    model: KMeansModel

    @property
    def order(self) -> list[int]:
        centers = [[round(float(x), 6) for x in c] for c in self.model.clusterCenters()]
        return sorted(range(len(centers)), key=lambda i: centers[i])

    def centers(self) -> list[list[float]]:
        found = self.model.clusterCenters()
        return [[float(x) for x in found[i]] for i in self.order]

    def label(self, vectors: DataFrame) -> DataFrame:
        numbers = ", ".join(f"{old}, {new}" for new, old in enumerate(self.order))
        return self.model.transform(vectors).withColumn("cluster", F.expr(f"map({numbers})[cluster]"))


def best_kmeans(vectors: DataFrame, k: int, cfg: Settings) -> Clusters:
    """Lowest training cost over several seeds, fitted side by side."""
    fits = together({i: partial(_kmeans(k, cfg.seed + i).fit, vectors) for i in range(cfg.cluster_restarts)}, cfg.fits_at_once)
    return _cheapest(fits.values())


def _kmeans(k: int, seed: int) -> KMeans:
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster")


def _cheapest(fits: Iterable[KMeansModel]) -> Clusters:
    return Clusters(min(fits, key=lambda m: m.summary.trainingCost))


def scan_k(design: Design, cfg: Settings) -> DataFrame:
    """Inertia, silhouette, Davies-Bouldin and Calinski-Harabasz for every k of the range."""
    vectors = laid_out(design.vectors(), cfg.tree_rows_per_task, "cluster-rows").cache()
    silhouette = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")
    rows, ks = [], range(cfg.cluster_k_min, cfg.cluster_k_max + 1)
    fits = together({(k, i): partial(_kmeans(k, cfg.seed + i).fit, vectors) for k in ks for i in range(cfg.cluster_restarts)}, cfg.fits_at_once)
    for k in ks:
        fitted = _cheapest(model for (own, _), model in fits.items() if own == k)
        labelled = fitted.label(vectors)
        between, separation = _internal_indices(labelled, design.columns)
        rows.append((k, float(fitted.model.summary.trainingCost), float(silhouette.evaluate(labelled)), separation, between))
    vectors.unpersist()
    return design.frame.sparkSession.createDataFrame(
        rows, "k int, inertia double, silhouette double, davies_bouldin double, calinski_harabasz double")


def _internal_indices(labelled: DataFrame, columns: tuple[str, ...]) -> tuple[float, float]:
    """(Calinski-Harabasz, Davies-Bouldin) from k rows of cluster statistics."""
    centers = labelled.groupBy("cluster").agg(*[F.expr(f"avg({c}) AS {c}_c") for c in columns])
    squares = " + ".join(f"power({c} - {c}_c, 2)" for c in columns)
    spread = labelled.join(F.broadcast(centers), "cluster").groupBy("cluster").agg(  # k rows, k <= cluster_k_max
        F.expr("count(1) AS n"), F.expr(f"sum({squares}) AS within"), F.expr(f"avg(sqrt({squares})) AS radius"),
        *[F.expr(f"max({c}_c) AS {c}_c") for c in columns]).collect()
    points = [[r[f"{c}_c"] for c in columns] for r in spread]
    n, k = sum(r["n"] for r in spread), len(spread)
    if k < 2 or n <= k:
        return math.nan, math.nan
    middle = [sum(r["n"] * p[d] for r, p in zip(spread, points)) / n for d in range(len(columns))]
    between = sum(r["n"] * math.dist(p, middle) ** 2 for r, p in zip(spread, points))
    within = sum(r["within"] for r in spread)
    worst = [
        max((spread[i]["radius"] + spread[j]["radius"]) / math.dist(points[i], points[j]) for j in range(k) if j != i)
        for i in range(k)]
    return (between / (k - 1)) / (within / (n - k)) if within else math.nan, sum(worst) / k


def choose_k(scan: DataFrame) -> DataFrame:
    """One row: the k with the highest silhouette, the smaller one on ties."""
    return scan.agg(F.expr("-max(struct(silhouette, -k AS neg)).neg AS k"))


def fit_clusters(design: Design, k: int, cfg: Settings) -> tuple[DataFrame, Clusters]:
    """Cluster label per customer, and the fitted clusters."""
    vectors = laid_out(design.vectors(), cfg.tree_rows_per_task, "cluster-rows").cache()
    fitted = best_kmeans(vectors, k, cfg)
    vectors.unpersist()
    return fitted.label(design.vectors()).select("account_id", "cluster"), fitted


def centroids(fitted: Clusters, design: Design) -> DataFrame:
    """Cluster centres in original units: z-score undone, then the logarithm."""
    rows = []
    for i, center in enumerate(fitted.centers()):
        for c, z in zip(design.columns, center):
            value = z * design.stds[c] + design.means[c]
            rows.append((i, c, math.expm1(value) if c in LOG_FEATURES else value))
    return design.frame.sparkSession.createDataFrame(rows, "cluster int, feature string, value double")


def assign_segments(clients: DataFrame, labels: DataFrame) -> DataFrame:
    """Customers with a `segment`; those without identity form their own."""
    return clients.join(labels, "account_id", "left").withColumn("segment", F.expr(
        f"CASE WHEN identity_missing = 1 THEN '{MISSING}' ELSE concat('cluster ', CAST(cluster AS STRING)) END"))


def segment_profile(segments: DataFrame) -> DataFrame:
    """Size, share and means in original units per segment."""
    means = segments.groupBy("segment").agg(
        F.expr("count(1) AS clients"), *[F.expr(f"avg({c}) AS {c}") for c in PROFILE_MEANS])
    return means.selectExpr("segment", "clients", "clients / sum(clients) OVER () AS share", *PROFILE_MEANS)


def name_personas(profile: DataFrame) -> DataFrame:
    """Business names by descending spend; one row per segment comes in, so one task is enough."""
    fitted = f"segment <> '{MISSING}'"
    by_spend = Window.partitionBy(F.expr(fitted)).orderBy(F.desc("spend_total"), F.asc("segment"))
    return (
        profile.withColumn("_place", F.row_number().over(by_spend))
        .withColumn("_count", F.count(F.lit(1)).over(Window.partitionBy(F.expr(fitted))))
        .withColumn("persona", F.expr(
            f"CASE WHEN NOT ({fitted}) THEN '{UNREGISTERED}' WHEN _count = 1 THEN '{BASE}'"
            f" WHEN _place = 1 THEN '{HIGH}' WHEN _place = _count THEN '{LOW}'"
            f" ELSE concat('{MID} ', CAST(_place - 1 AS STRING)) END"))
        .drop("_place", "_count")
    )


def segment_response(processed: DataFrame, segments: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Views, conversions and margin per segment and offer type."""
    joined = keyed_join(processed, segments.select("account_id", "segment"), "account_id", hot, "inner")
    return joined.groupBy("segment", "offer_type").agg(
        F.expr("count(1) AS sends"), F.expr("sum(treatment) AS viewed"), F.expr("sum(converted) AS converted"),
        F.expr("sum(conversion_value) AS revenue"), F.expr("sum(reward_cost) AS cost"),
    ).selectExpr("*", "viewed / sends AS view_rate", "converted / sends AS conversion_rate",
                 "try_divide(converted, viewed) AS conversion_per_view", "(revenue - cost) / sends AS margin_per_send")


def segment_z_scores(profile: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Each mean as a z-score across segments; null where all segments agree."""
    stats = profile.agg(*[F.expr(f"{fn}({c}) AS {c}_{s}") for c in columns for fn, s in (("avg", "m"), ("stddev_pop", "s"))])
    return profile.crossJoin(stats).selectExpr(
        "segment", *[f"IF({c}_s > 0, ({c} - {c}_m) / {c}_s, NULL) AS {c}" for c in columns])


def persona_synthesis(personas: DataFrame, response: DataFrame) -> DataFrame:
    """Mean margin over types and the best offer type per persona."""
    best = response.groupBy("segment").agg(
        F.expr("avg(margin_per_send) AS mean_margin"),
        F.expr("max_by(offer_type, struct(margin_per_send, offer_type)) AS best_offer_type"))
    return personas.select("segment", "persona", "clients", "share").join(best, "segment", "left").drop("segment")
