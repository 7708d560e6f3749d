"""Fixed points of fitted models: what must hold for any right fit, stated in SQL as the expected table."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offertide.functions.ranked import Ranked
from offertide.models import conversion
from offertide.operators import segments
from offertide.registry.core import query
from offertide.registry.model import _LINEAR
from offertide.sources.testbed import SETTINGS


@query("m3_logistic_gradient", f"SELECT unnest(range(0, {len(_LINEAR) + 1}))::INT AS slot, true AS settled")
def _(w):
    """The penalised likelihood is flat in every coefficient, the intercept being the last slot."""
    train, _ = w.split
    matrix, model = conversion.logistic_anchor(train, w.cfg)
    coefficients = [float(c) for c in model.coefficients]
    rows = model.transform(matrix.transform(train)).select(
        (vector_to_array("probability")[1] - F.col("converted")).alias("miss"),
        F.concat(vector_to_array("linear"), F.array(F.lit(1.0))).alias("x"))
    slope = rows.select("miss", F.posexplode("x").alias("slot", "x")).groupBy("slot").agg(F.avg(F.expr("miss * x")).alias("slope"))
    penalty = F.array(*[F.lit(c * model.getRegParam()) for c in coefficients], F.lit(0.0))
    return slope.select("slot", (F.abs(F.col("slope") + penalty[F.col("slot")]) < 1e-3).alias("settled"))


def rank_auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """One row with the share of (positive, negative) pairs in right order, ties by half, from ranks over a range layout."""
    tied = scored.groupBy(F.col(score).alias("s")).agg(F.sum(label).cast("double").alias("p"), F.count("*").cast("double").alias("n"))
    layout = Ranked(tied, [F.asc("s")], sized=True)
    upto = layout.running(layout.rows, {"below": F.col("n") - F.col("p")})
    return upto.agg((F.sum(F.expr("p * (below - (n - p) / 2)")) / (F.sum("p") * F.sum(F.expr("n - p")))).alias("auc"))


@query("m4_auc_by_ranks", "SELECT 'logistic' AS model, true AS same_auc")
def _(w):
    """The evaluator's area equals the share of well ordered pairs."""
    train, holdout = w.split
    matrix, model = conversion.logistic_anchor(train, w.cfg)
    scored = model.transform(matrix.transform(holdout)).withColumn("p", vector_to_array("probability")[1])
    area = conversion.auc(scored)
    return rank_auc(scored, "p", "converted").select(F.lit("logistic").alias("model"), (F.abs(F.col("auc") - area) < 1e-9).alias("same_auc"))


@query("g3_scan_bounds", "SELECT unnest(range(2, 9))::INT AS k, true AS inertia_falls, true AS in_bounds")
def _(w):
    """More clusters never cost more, and each index lies in its range."""
    scan = segments.scan_k(segments.design_matrix(w.clients, w.cfg), w.cfg)
    before = F.lag("inertia").over(Window.orderBy("k"))  # a row per k
    return scan.select("k", F.coalesce(F.col("inertia") <= before * 1.001, F.lit(True)).alias("inertia_falls"),
                       F.expr("silhouette BETWEEN -1 AND 1 AND davies_bouldin > 0 AND calinski_harabasz > 0 AND inertia > 0").alias("in_bounds"))


def _clustered(w):
    design = segments.design_matrix(w.clients, w.cfg)
    labels, fitted = segments.fit_clusters(design, 3, w.cfg)
    return design, labels, fitted


@query("g5_cluster_fixed_point", "SELECT unnest([0, 1, 2])::INT AS cluster, true AS has_members, 0::BIGINT AS misplaced, true AS centre_is_mean")
def _(w):
    """Every customer is nearest its own centre, and a centre is the mean of its customers."""
    design, labels, fitted = _clustered(w)
    x = [F.col(c) for c in design.columns]
    gaps = [sum(((v - F.lit(c)) * (v - F.lit(c)) for v, c in zip(x[1:], center[1:])), (x[0] - F.lit(center[0])) ** 2) for center in fitted.centers()]
    own = F.element_at(F.array(*gaps), F.col("cluster") + 1)
    off = [F.abs(F.avg(c) - F.element_at(F.array(*[F.lit(m[d]) for m in fitted.centers()]), F.first("cluster") + 1))
           for d, c in enumerate(design.columns)]
    return design.frame.join(labels, "account_id").groupBy("cluster").agg(
        (F.count("*") > 0).alias("has_members"), F.count(F.when(own > F.least(*gaps) + 1e-9, 1)).alias("misplaced"),
        (F.greatest(*off) < 0.02).alias("centre_is_mean")).withColumn("cluster", F.col("cluster").cast("int"))


@query("g13_centroid_means", "SELECT unnest([0, 1, 2])::INT AS cluster, unnest([{n}, {n}, {n}])::BIGINT AS features, true AS is_geometric_mean".format(
    n=len(SETTINGS.cluster_features)))
def _(w):
    """A centre in original units is the mean of its customers, on the logarithmic scale where the feature is logged."""
    design, labels, fitted = _clustered(w)
    shown = segments.centroids(fitted, design)
    long = ", ".join(f"struct('{c}' AS feature, CAST({f'ln(1 + {c})' if c in segments.LOG_FEATURES else c} AS DOUBLE) AS v)" for c in design.columns)
    means = w.clients.join(labels, "account_id").selectExpr("cluster", f"inline(array({long}))").groupBy("cluster", "feature").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    logged = F.col("feature").isin(*segments.LOG_FEATURES)
    value = F.when(logged, F.log1p("value")).otherwise(F.col("value"))
    return shown.join(means, ["cluster", "feature"]).withColumn("scale", F.greatest("std", F.lit(1e-6))).groupBy("cluster").agg(
        F.count("*").alias("features"), F.bool_and(F.abs(value - F.col("mean")) < 0.05 * F.col("scale")).alias("is_geometric_mean"))
