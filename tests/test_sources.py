import json

import pytest
from pyspark.sql import functions as F

from offertide.operators.clean import normalize_profile
from offertide.operators.contract import PROCESSED_SCHEMA
from offertide.sources import files


def _lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def test_both_reference_spellings_become_one(spark, tmp_path):
    path = _lines(tmp_path / "events.json", [
        {"account_id": "a", "event": "offer received", "time_since_test_start": 0.0, "value": {"offer id": "o1"}},
        {"account_id": "a", "event": "offer viewed", "time_since_test_start": 1.0, "value": {"offer id": "o1"}},
        {"account_id": "a", "event": "offer completed", "time_since_test_start": 2.0, "value": {"offer_id": "o1", "reward": 5.0}},
        {"account_id": "a", "event": "transaction", "time_since_test_start": 2.0, "value": {"amount": 12.5}},
    ])
    rows = files.parse_events(files.read_events(spark, path)).orderBy("time", "event").collect()
    assert [r["offer_ref"] for r in rows] == ["o1", "o1", "o1", None]
    assert rows[2]["reward"] == 5.0 and rows[3]["amount"] == 12.5


def test_all_null_reference_keeps_its_type(spark, tmp_path):
    path = _lines(tmp_path / "events.json", [
        {"account_id": "a", "event": "transaction", "time_since_test_start": 2.0, "value": {"amount": 1.0}}])
    parsed = files.parse_events(files.read_events(spark, path))
    assert dict(parsed.dtypes)["offer_ref"] == "string" and parsed.first()["offer_ref"] is None


def test_array_file_needs_multi_line(spark, tmp_path):
    path = tmp_path / "offers.json"
    path.write_text(json.dumps([
        {"id": "o1", "offer_type": "bogo", "min_value": 10, "discount_value": 5, "duration": 7.0, "channels": ["web"]},
        {"id": "o2", "offer_type": "discount", "min_value": 5, "discount_value": 2, "duration": 3.0, "channels": []},
    ], indent=1))
    offers = files.read_offers(spark, str(path), multi_line=True)
    assert offers.count() == 2 and offers.where("id = 'o1'").first()["channels"] == ["web"]


def test_sentinel_profile(spark, cfg):
    raw = spark.createDataFrame([
        ("a", 118, None, None, "20180716"), ("b", 40, "F", 5000.0, "20180726"), ("c", 30, "M", 10.0, "not a date"),
    ], files.PROFILE_SCHEMA)
    rows = {r["account_id"]: r for r in normalize_profile(raw, cfg).collect()}
    assert rows["a"]["age"] is None and rows["a"]["identity_missing"] == 1 and rows["a"]["gender"] == "unknown"
    assert rows["a"]["tenure_days"] == 10
    assert rows["b"]["age"] == 40 and rows["b"]["identity_missing"] == 0 and rows["b"]["tenure_days"] == 0
    assert rows["c"]["tenure_days"] is None


def test_processed_round_trip_checks_the_schema(spark, tmp_path):
    empty = spark.createDataFrame([], PROCESSED_SCHEMA)
    files.write_processed(empty, str(tmp_path / "p"))
    assert files.read_processed(spark, str(tmp_path / "p")).columns == PROCESSED_SCHEMA.names


def test_recommendations_are_written_in_rank_order(spark, tmp_path):
    rows = spark.range(1, 201).select(
        F.col("id").alias("rank"), F.concat(F.lit("a"), F.col("id")).alias("account_id"), F.lit("o").alias("offer_id"),
        F.lit("bogo").alias("offer_type"), (-F.col("id")).cast("double").alias("score"))
    out = str(tmp_path / "csv")
    files.write_recommendations(rows.repartition(7), out)
    parts = sorted((tmp_path / "csv").glob("part-*.csv"))
    seen = [int(line.split(",")[0]) for p in parts for line in p.read_text().splitlines()[1:]]
    assert seen == list(range(1, 201))


def test_contract_lists_missing_columns(spark):
    from offertide.operators.contract import check_schema, enforce_schema

    df = spark.range(1).selectExpr("'a' AS account_id")
    with pytest.raises(ValueError, match="offer_id"):
        enforce_schema(df)
    with pytest.raises(ValueError):
        check_schema(df, strict=True)
    # account_id itself is in place, the other positions differ
    assert check_schema(df).count() == len(PROCESSED_SCHEMA) - 1


@pytest.mark.parametrize("spoil", ["missing", "reordered", "retyped"])
def test_processed_files_must_keep_the_contract(spark, tmp_path, spoil):
    empty = spark.createDataFrame([], PROCESSED_SCHEMA)
    wrong = {
        "missing": empty.drop("converted"),
        "reordered": empty.select(*reversed(empty.columns)),
        "retyped": empty.withColumn("converted", empty["converted"].cast("double")),
    }[spoil]
    files.write_processed(wrong, str(tmp_path / "p"))
    with pytest.raises(ValueError):
        files.read_processed(spark, str(tmp_path / "p"))
