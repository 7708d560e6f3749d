import math
import random

import pytest

from offertide.operators import describe, segments

CLIENT = ("account_id string, age int, credit_card_limit double, tenure_days int, identity_missing int, spend_total double,"
          " txn_count bigint, avg_ticket double, view_rate double, offers_received bigint, conv_rate double, margin double")


@pytest.fixture
def clients(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        rich, missing = i % 2, i % 10 == 9
        spend = rng.uniform(900, 1000) if rich else rng.uniform(5, 20)
        rows.append((f"c{i}", None if missing else 30 + rich * 30 + rng.randrange(3), None if missing else 1000.0 + 9000 * rich + rng.random(),
                     100 + 900 * rich + rng.randrange(9), int(missing), spend, 10 + 20 * rich, spend / 10, 0.2 + 0.5 * rich, 5, 0.3, spend / 9))
    return spark.createDataFrame(rows, CLIENT)


def test_matrix_is_standardised_without_missing_profiles(clients, cfg):
    design = segments.design_matrix(clients, cfg)
    assert design.frame.count() == clients.where("identity_missing = 0").count()
    row = design.frame.selectExpr(*[f"avg({c}) AS m_{c}" for c in design.columns], *[f"stddev_pop({c}) AS s_{c}" for c in design.columns]).first()
    assert all(abs(row[f"m_{c}"]) < 1e-9 and abs(row[f"s_{c}"] - 1) < 1e-9 for c in design.columns)


def test_null_or_constant_features_are_refused(clients, cfg):
    with pytest.raises(ValueError, match="null"):
        segments.design_matrix(clients.withColumn("identity_missing", clients["identity_missing"] * 0), cfg)
    with pytest.raises(ValueError, match="constant"):
        segments.design_matrix(clients.withColumn("tenure_days", clients["identity_missing"] * 0), cfg)


def test_two_obvious_groups_are_found(clients, cfg):
    cfg = cfg.but(cluster_restarts=2, cluster_k_max=4)
    design = segments.design_matrix(clients, cfg)
    scan = segments.scan_k(design, cfg)
    rows = {r["k"]: r for r in scan.collect()}
    assert set(rows) == {2, 3, 4} and segments.choose_k(scan).first()["k"] == 2
    assert rows[2]["davies_bouldin"] < rows[3]["davies_bouldin"] and rows[2]["inertia"] > rows[4]["inertia"]
    labels, model = segments.fit_clusters(design, 2, cfg)
    assert labels.collect() == segments.fit_clusters(design, 2, cfg)[0].collect()
    marked = segments.assign_segments(clients, labels)
    assert marked.where("segment = 'missing identity'").count() == 6
    centers = {(r["cluster"], r["feature"]): r["value"] for r in segments.centroids(model, design).collect()}
    spends = sorted(v for (c, f), v in centers.items() if f == "spend_total")
    assert spends[0] < 25 and 850 < spends[1] < 1050
    personas = {r["persona"] for r in segments.name_personas(segments.segment_profile(marked)).collect()}
    assert personas == {"High value", "Low ticket", "Incomplete registration"}


def test_persona_names(spark):
    def names(*rows):
        df = spark.createDataFrame([(s, v) for s, v in rows], "segment string, spend_total double")
        return {r["segment"]: r["persona"] for r in segments.name_personas(df).collect()}

    assert names(("cluster 0", 5.0)) == {"cluster 0": "Base"}
    assert names(("cluster 0", 5.0), ("cluster 1", 50.0), ("cluster 2", 20.0), ("cluster 3", 10.0), ("missing identity", 99.0)) == {
        "cluster 1": "High value", "cluster 2": "Mid value 1", "cluster 3": "Mid value 2", "cluster 0": "Low ticket",
        "missing identity": "Incomplete registration"}


def test_constant_mean_has_no_z_score(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 2.0)], "segment string, x double, y double")
    rows = {r["segment"]: r for r in segments.segment_z_scores(df, ("x", "y")).collect()}
    assert rows["a"]["x"] == -1.0 and rows["a"]["y"] is None


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (9.99,), (10.0,), (None,)], "v double")
    rows = {r["center"]: r["rows"] for r in describe.numeric_histogram(df, "v", 10).collect()}
    assert rows == {0.5: 1, 1.5: 1, 9.5: 2}
    assert describe.numeric_histogram(df.where("v = 1"), "v", 10).collect()[0].asDict() == {"center": 1.0, "rows": 1}
    assert describe.numeric_histogram(df.where("v IS NULL"), "v", 10).count() == 0


def test_balance_of_separating_covariate_is_infinite(spark, cfg):
    cols = (*describe.PROFILE_COVARIATES, *describe.PURCHASE_HISTORY, *describe.OFFER_HISTORY)
    base = spark.range(20).selectExpr(
        "CAST(id % 2 AS INT) AS treatment", "IF(id < 10, 'F', 'M') AS gender",
        *[f"CAST(id AS DOUBLE) AS {c}" for c in cols if c not in ("age", "tenure_days")],
        "CAST(id % 2 AS INT) AS age", "5 AS tenure_days")
    rows = {r["covariate"]: r for r in describe.covariate_balance(base, cfg).collect()}
    assert math.isinf(rows["age"]["smd"]) and rows["age"]["above_threshold"]
    assert rows["tenure_days"]["smd"] == 0.0 and "gender=F" in rows
    finite = {r["covariate"] for r in describe.balance_index(describe.covariate_balance(base, cfg)).collect()}
    assert "age" not in finite and "tenure_days" in finite


def test_bootstrap_interval_contains_the_mean(spark, cfg):
    rows = [(f"a{i}", "o", 0.0, i % 2, 10.0 + i if i % 2 else 0.0) for i in range(200)]
    df = spark.createDataFrame(rows, "account_id string, offer_id string, received_time double, converted int, conversion_value double")
    out = {r["converted"]: r for r in describe.ticket_by_conversion(df, cfg, replicates=50).collect()}
    assert out[0]["mean"] == out[0]["mean_lo"] == out[0]["mean_hi"] == 0.0
    assert out[1]["mean_lo"] < out[1]["mean"] < out[1]["mean_hi"] and out[1]["received"] == 100
