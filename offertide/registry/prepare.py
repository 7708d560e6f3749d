"""Sources, cleaning, attribution, features and the processed table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from offertide.functions.storage import shared_folder
from offertide.operators import attribution, clean, contract, features
from offertide.plans import processed as prep
from offertide.registry.core import query
from offertide.settings import DONE, GRAIN, LATEST, SEEN
from offertide.sources import files

_GRAIN_SQL = "account_id, offer_id, received_time"
_TIMES = "received_time"


def _target(w, name: str) -> str:
    return f"{shared_folder(w.spark)}/{name}-{uuid.uuid4().hex}"


# Sources and sinks

@query("s1_read_offers", "SELECT id, offer_type, min_value, discount_value, duration, array_to_string(channels, ',') AS channels FROM offers",
       "min_value discount_value duration")
def _(w):
    path = _target(w, "offers-json")
    w.offers.write.json(path)
    return files.read_offers(w.spark, path).withColumn("channels", F.array_join("channels", ","))


@query("s2_read_profile", "SELECT * FROM raw_profile", "credit_card_limit")
def _(w):
    path = _target(w, "profile-json")
    w.raw_profile.write.json(path)
    return files.read_profile(w.spark, path)


@query("s3_read_events", """
SELECT account_id, event, time AS time_since_test_start,
  CASE WHEN event IN ('offer received', 'offer viewed') THEN offer_ref END AS ref_spaced,
  CASE WHEN event = 'offer completed' THEN offer_ref END AS ref_underscored, amount, reward FROM log""",
       "time_since_test_start amount reward")
def _(w):
    path = _target(w, "events-json")
    w.raw_events.write.json(path)
    return files.read_events(w.spark, path).select(
        "account_id", "event", "time_since_test_start",
        F.col("value.`offer id`").alias("ref_spaced"), F.col("value.offer_id").alias("ref_underscored"),
        "value.amount", "value.reward",
    )


_CONTRACT_SQL = f"SELECT {', '.join(contract.COLUMNS)} FROM processed"
_CONTRACT_DOUBLES = " ".join(f.name for f in contract.PROCESSED_SCHEMA.fields if f.dataType.typeName() == "double")


@query("s4_write_processed", _CONTRACT_SQL, _CONTRACT_DOUBLES)
def _(w):
    path = _target(w, "processed")
    files.write_processed(w.processed, path)
    return w.spark.read.parquet(path)


@query("s5_read_processed", _CONTRACT_SQL, _CONTRACT_DOUBLES)
def _(w):
    path = _target(w, "processed")
    files.write_processed(w.processed, path)
    return files.read_processed(w.spark, path)


# Projections and cleaning

@query("p1_parse_events", "SELECT * FROM log", "time amount reward")
def _(w):
    return files.parse_events(w.raw_events)


@query("p2_normalize_profile", "SELECT * FROM profile", "credit_card_limit")
def _(w):
    return clean.normalize_profile(w.raw_profile, w.cfg)


@query("p3_split_log", """
SELECT 'received' AS part, account_id, offer_id, received_time AS time, NULL::DOUBLE AS amount FROM receipts
UNION ALL SELECT 'viewed', account_id, offer_id, view_time, NULL FROM views
UNION ALL SELECT 'transaction', account_id, NULL, txn_time, txn_amount FROM txns""", "time amount")
def _(w):
    none, no_offer = F.lit(None).cast("double").alias("amount"), F.lit(None).cast("string").alias("offer_id")
    received = clean.receipts(w.log).select(
        F.lit("received").alias("part"), "account_id", "offer_id", F.col("received_time").alias("time"), none)
    viewed = clean.views(w.log).select(
        F.lit("viewed").alias("part"), "account_id", "offer_id", F.col("view_time").alias("time"), none)
    bought = clean.transactions(w.log).select(
        F.lit("transaction").alias("part"), "account_id", no_offer, F.col("txn_time").alias("time"),
        F.col("txn_amount").alias("amount"))
    return received.unionByName(viewed).unionByName(bought)


@query("p4_treatment", f"SELECT {_GRAIN_SQL}, treatment FROM processed", _TIMES)
def _(w):
    attributed = attribution.attribute(w.log, w.offers, w.cfg, w.hot)
    return clean.add_treatment(attributed).select(*GRAIN, "treatment")


@query("p5_reward_cost", f"SELECT {_GRAIN_SQL}, offer_type, converted, reward_cost FROM processed",
       "received_time reward_cost")
def _(w):
    labelled = attribution.build_label(attribution.attribute(w.log, w.offers, w.cfg, w.hot))
    return clean.add_reward_cost(labelled, w.offers).select(*GRAIN, "offer_type", "converted", "reward_cost")


@query("p6_enforce_schema", _CONTRACT_SQL, _CONTRACT_DOUBLES)
def _(w):
    return contract.enforce_schema(w.assembled)


@query("p7_temporal_split", f"SELECT {_GRAIN_SQL}, campaign_wave, CASE WHEN campaign_wave < 4 THEN 'train' ELSE 'holdout' END AS side FROM processed", _TIMES)
def _(w):
    train, holdout = clean.temporal_split(w.processed, w.cfg)
    keep = [*GRAIN, "campaign_wave"]
    return (train.select(*keep, F.lit("train").alias("side"))
            .unionByName(holdout.select(*keep, F.lit("holdout").alias("side"))))


@query("p8_paid_types_only", f"SELECT {_GRAIN_SQL}, offer_type FROM processed WHERE offer_type <> 'informational'", _TIMES)
def _(w):
    return clean.paid_types_only(w.processed).select(*GRAIN, "offer_type")


@query("p9_net_profit", f"SELECT {_GRAIN_SQL}, conversion_value - reward_cost AS net_profit FROM processed",
       "received_time net_profit")
def _(w):
    return clean.add_net_profit(w.processed).select(*GRAIN, "net_profit")


# Attribution

@query("t1_validity", f"SELECT {_GRAIN_SQL}, duration, min_value, valid_until FROM validity",
       "received_time duration min_value valid_until")
def _(w):
    return attribution.with_validity(clean.receipts(w.log), w.offers).select(
        *GRAIN, "duration", "min_value", "valid_until")


_T2 = """SELECT {m} AS mode, account_id, offer_id, received_time,
  row_number() OVER (PARTITION BY account_id ORDER BY received_time {d}, offer_id) AS priority FROM receipts"""


@query("t2_priority_order", _T2.format(m="'earliest'", d="ASC") + " UNION ALL " + _T2.format(m="'latest'", d="DESC"), _TIMES)
def _(w):
    received = clean.receipts(w.log)
    first = attribution.ranked_receipts(received, w.cfg, w.hot)
    last = attribution.ranked_receipts(received, w.cfg.but(attribution_priority=LATEST), w.hot)
    return (first.select(F.lit("earliest").alias("mode"), "*")
            .unionByName(last.select(F.lit("latest").alias("mode"), "*")))


@query("t3_owned_views", "SELECT * FROM owned_views", "received_time view_time")
def _(w):
    return attribution.owned_views(w.received, clean.views(w.log), w.cfg, w.hot)


@query("t4_candidate_transactions",
       "SELECT account_id, txn_time, txn_amount, count(*) AS n_candidates FROM candidates GROUP BY txn_id, 1, 2, 3",
       "txn_time txn_amount")
def _(w):
    return attribution.candidate_transactions(w.received, clean.transactions(w.log), w.hot)


@query("t5_overlap_report", """
SELECT count(*) AS eligible_txns, count(*) FILTER (n > 1) AS contested_txns, max(n) AS most_candidates
FROM (SELECT txn_id, count(*) AS n FROM candidates GROUP BY 1)""")
def _(w):
    found = attribution.candidate_transactions(w.received, clean.transactions(w.log), w.hot)
    return attribution.overlap_report(found)


@query("t6_owned_transactions", f"SELECT {_GRAIN_SQL}, txn_time, txn_amount FROM owned",
       "received_time txn_time txn_amount")
def _(w):
    return attribution.owned_transactions(w.received, clean.transactions(w.log), w.cfg, w.hot)


_LATEST_SQL = f"""SELECT {_GRAIN_SQL}, txn_time, txn_amount FROM (
  SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY received_time DESC, offer_id) AS k FROM candidates) WHERE k = 1"""


@query("t6_owned_transactions_latest", _LATEST_SQL, "received_time txn_time txn_amount")
def _(w):
    cfg = w.cfg.but(attribution_priority=LATEST)
    return attribution.owned_transactions(w.received, clean.transactions(w.log), cfg, w.hot)


@query("t7_first_transactions", f"""
SELECT {_GRAIN_SQL}, 1::BIGINT AS assigned_txn_count, txn_amount AS assigned_txn_amount_sum,
  txn_time AS first_assigned_txn_time FROM firsts""",
       "received_time assigned_txn_amount_sum first_assigned_txn_time")
def _(w):
    owned = attribution.owned_transactions(w.received, clean.transactions(w.log), w.cfg, w.hot)
    return attribution.first_transactions(owned)


@query("t8_attribution", "SELECT * FROM attributed",
       "received_time valid_until view_time assigned_txn_amount_sum first_assigned_txn_time")
def _(w):
    return attribution.attribute(w.log, w.offers, w.cfg, w.hot)


@query("t9_label", f"SELECT {_GRAIN_SQL}, converted, conversion_value FROM labelled", "received_time conversion_value")
def _(w):
    labelled = attribution.build_label(attribution.attribute(w.log, w.offers, w.cfg, w.hot))
    return labelled.select(*GRAIN, "converted", "conversion_value")


@query("t10_recurrence", f"SELECT {_GRAIN_SQL}, converted, is_recurrent FROM recurrent", _TIMES)
def _(w):
    return prep.label_receipts(w.log, w.offers, w.cfg, w.hot).select(*GRAIN, "converted", "is_recurrent")


# Features

def _block(w, block):
    return features.history_block(clean.receipts(w.log), w.log, w.offers, block, w.hot)


@query("f1_purchase_history", "SELECT * FROM f_purchases",
       "received_time hist_spend_total hist_avg_ticket hist_spend_std hist_recency_days hist_frequency hist_spend_trend")
def _(w):
    return _block(w, features.PURCHASES)


@query("f2_response_history", "SELECT * FROM f_responses",
       "received_time hist_view_rate hist_conv_rate_bogo hist_conv_rate_discount")
def _(w):
    return _block(w, features.RESPONSES)


@query("f3_completed_unseen", f"SELECT {_GRAIN_SQL}, hist_completed_unseen_flag FROM f_finished", _TIMES)
def _(w):
    return _block(w, features.UNSEEN)


@query("f4_time_view_to_conversion", f"SELECT {_GRAIN_SQL}, hist_time_view_to_conv FROM f_finished",
       "received_time hist_time_view_to_conv")
def _(w):
    return _block(w, features.DELAY)


@query("f5_offer_terms", "SELECT * FROM f_terms",
       "received_time discount_value min_value duration discount_to_minvalue_ratio")
def _(w):
    return features.offer_terms(clean.receipts(w.log), w.offers)


@query("f6_concurrent_offers", "SELECT * FROM f_active", _TIMES)
def _(w):
    return _block(w, features.ACTIVE)


_FEATURE_COLUMNS = [c for c in contract.COLUMNS if c.startswith("hist_")] + [
    "discount_value", "min_value", "duration", "n_channels", "channel_web", "channel_email",
    "channel_mobile", "channel_social", "discount_to_minvalue_ratio", "n_concurrent_offers"]


@query("f7_all_features", f"SELECT {_GRAIN_SQL}, {', '.join(_FEATURE_COLUMNS)} FROM processed",
       " ".join(c for c in _CONTRACT_DOUBLES.split() if c in (*_FEATURE_COLUMNS, "received_time")))
def _(w):
    received = clean.receipts(w.log)
    return features.add_features(w.log, received, w.offers, hot=w.hot).select(*GRAIN, *_FEATURE_COLUMNS)


@query("f8_campaign_wave", "SELECT received_time, campaign_wave, count(*) AS n FROM processed GROUP BY 1, 2", _TIMES)
def _(w):
    received = clean.receipts(w.log)
    waves = prep.campaign_waves(received, w.cfg)
    return (prep.add_campaign_wave(received, waves).groupBy("received_time", "campaign_wave")
            .agg(F.count(F.lit(1)).alias("n")))


@query("f9_processed_table", _CONTRACT_SQL, _CONTRACT_DOUBLES)
def _(w):
    return prep.build_processed(w.log, w.offers, w.profile, w.cfg, w.hot)
