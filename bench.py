"""Wall time of the headline queries on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from offertide.registry import QUERIES
from offertide.registry.workspace import workspace

HEADLINE = (
    "p1_parse_events", "t4_candidate_transactions", "t8_attribution", "t10_recurrence",
    "f1_purchase_history", "f7_all_features", "f9_processed_table",
    "d9_feature_checks", "e10_conversion_by_tenure", "e13_numeric_profile", "e15_correlation_matrix",
    "e16_redundant_pairs", "e17_covariate_balance", "e19_assignment_balance", "e23_response_funnel", "e31_window_spend",
    "r1_uplift_ranking", "r13_gain_curves", "r16_conversions_by_decile", "r19_metrics_by_strategy",
    "q4_gain_by_quadrant", "v3_scoring_frame", "v4_recommend", "v8_allocate", "v10_projection",
    "g1_client_features", "g2_design_matrix", "g9_segment_response", "m7_effect_stages_fitted", "g5_fit_clusters", "j1_prepare", "j3_staged_history",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    # Stage the shared tables once and report what that costs.
    start = time.time()
    ws = workspace(spark, folder)
    ws.log, ws.hot, ws.assembled  # noqa: B018
    times["stage_log_and_processed"] = round(time.time() - start, 3)
    start = time.time()
    ws.scored, ws.matrix, ws.scored_holdout  # noqa: B018
    times["stage_scored_and_matrix"] = round(time.time() - start, 3)

    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.mode("overwrite").format("noop").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
