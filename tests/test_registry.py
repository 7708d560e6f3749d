"""Registered queries against their DuckDB oracles at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from offertide.operators import segments
from offertide.registry import workspace as workspace_module
from offertide.registry.workspace import workspace
from offertide.settings import Settings

FOLDER = "/root/testdata/sf0.001"
TABLES = ("part", "customer", "events")
SAMPLE = (
    "p1_parse_events", "t5_overlap_report", "t8_attribution", "f9_processed_table", "d15_raw_quality", "e10_conversion_by_tenure",
    "e23_response_funnel", "e31_window_spend", "r13_gain_curves", "r19_metrics_by_strategy", "v3_scoring_frame", "m8_effect",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="benchmark tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


HOT_SAMPLE = ("t2_priority_order", "t4_candidate_transactions", "e7_unseen_completions", "e8_spontaneous_share", "e31_window_spend",
              "v3_scoring_frame_active", "f9_processed_table")


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_oracle(spark, duck, name):
    _compare(spark, duck, name, FOLDER)


@pytest.mark.parametrize("name", HOT_SAMPLE)
def test_cutting_hot_accounts_changes_nothing(spark, duck, name):
    folder = f"{FOLDER}/."
    ws = workspace(spark, folder)
    ws.cfg = ws.cfg.but(rows_per_task=20)
    assert ws.hot is not None
    _compare(spark, duck, name, folder)


def _compare(spark, duck, name, folder):
    df = entry.queries()[name](spark, folder)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    have = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    want = sorted(tuple(_plain(dict(zip(rel.columns, r))[c]) for c in cols) for r in rel.fetchall())
    assert have == want and have


def test_models_and_clusters_run_at_the_configured_size(spark, monkeypatch):
    ws, seen = workspace(spark, f"{FOLDER}/./."), []

    class Stop(Exception):
        pass

    def spy(*args, **_):
        seen.append(next(a for a in args if isinstance(a, Settings)))
        raise Stop

    for owner, name in ((segments, "scan_k"), (segments, "fit_clusters"), (workspace_module, "EffectModel"), (workspace_module, "ConversionModel")):
        monkeypatch.setattr(owner, name, spy)
    for query in ("g3_scan_k", "g5_fit_clusters", "g13_centroids", "m7_effect_trees"):
        with pytest.raises(Stop):
            entry.queries()[query](spark, ws.folder)
    with pytest.raises(Stop):
        ws.blended
    assert len(seen) == 6 and all(cfg == ws.cfg for cfg in seen)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
