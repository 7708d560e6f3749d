"""Maps the benchmark tables (events, customer, part) to the raw offer-log shapes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offertide.functions.storage import small_or_same
from offertide.settings import BOUGHT, DONE, INFORMATIONAL, SEEN, SENT, Settings

START = "2024-01-01"
_DAY_US = 86_400_000_000.0

SETTINGS = Settings(test_start_date="20240101")


@dataclass(frozen=True)
class Raw:
    events: DataFrame
    profile: DataFrame
    offers: DataFrame


def raw_tables(spark: SparkSession, folder: str) -> Raw:
    return Raw(raw_events(spark, folder), raw_profile(spark, folder), raw_offers(spark, folder))


def raw_offers(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = (
        F.when(k % 5 < 2, "bogo").when(k % 5 < 4, "discount").otherwise(INFORMATIONAL)
    )
    informational = k % 5 == 4
    channels = F.filter(
        F.array(
            F.when(k % 2 == 0, "web"), F.lit("email"),
            F.when(k % 3 != 0, "mobile"), F.when(k % 4 == 1, "social"),
        ),
        lambda c: c.isNotNull(),
    )
    offers = (
        spark.read.parquet(f"{folder}/part.parquet")
        .select(
            F.concat(F.lit("o"), k.cast("string")).alias("id"),
            kind.alias("offer_type"),
            F.when(informational, 0.0).otherwise((10 + 5 * (k % 4)).cast("double")).alias("min_value"),
            F.when(informational, 0.0).otherwise((2 + k % 4).cast("double")).alias("discount_value"),
            (3 + k % 8).cast("double").alias("duration"),
            channels.alias("channels"),
        )
    )
    return small_or_same(offers, SETTINGS.small_table_rows)[0]


def raw_profile(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    hidden = k % 8 == 0
    day = F.date_sub(F.to_date(F.lit(START)), (k % 1500).cast("int"))
    return spark.read.parquet(f"{folder}/customer.parquet").select(
        k.cast("string").alias("id"),
        F.when(hidden, 118).otherwise((18 + k % 70).cast("int")).alias("age"),
        F.when(hidden, None).otherwise(
            F.when(k % 3 == 0, "M").when(k % 3 == 1, "F").otherwise("O")
        ).alias("gender"),
        F.when(~hidden, F.col("c_acctbal")).alias("credit_card_limit"),
        F.date_format(day, "yyyyMMdd").alias("registered_on"),
    )


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    """Nested raw log. Sends are snapped to five-day waves and made distinct; other kinds keep their name."""
    kind = (
        F.when(F.col("event_type") == "signup", SENT)
        .when(F.col("event_type") == "view", SEEN)
        .when(F.col("event_type") == "click", DONE)
        .when(F.col("event_type") == "purchase", BOUGHT)
        .otherwise(F.col("event_type"))
    )
    micros = F.expr(
        f"timestampdiff(MICROSECOND, timestamp_ntz'{START} 00:00:00', ts)"
    ).cast("double")
    number = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    log = (
        spark.read.parquet(f"{folder}/events.parquet")
        .select(
            F.col("user_id").cast("string").alias("account_id"),
            kind.alias("event"),
            (micros / F.lit(_DAY_US)).alias("time"),
            F.concat(F.lit("o"), number.cast("string")).alias("ref"),
            F.col("value").alias("v"),
        )
    )
    sends = (
        log.where(F.col("event") == SENT)
        .select("account_id", "event", (F.floor(F.col("time") / 5) * 5).cast("double").alias("time"), "ref")
        .distinct()
        .withColumn("v", F.lit(None).cast("double"))
    )
    others = log.where(~F.col("event").eqNullSafe(SENT))
    event = F.col("event")
    return sends.unionByName(others).select(
        "account_id",
        "event",
        F.col("time").alias("time_since_test_start"),
        F.struct(
            F.when(event.isin(SENT, SEEN), F.col("ref")).alias("offer id"),
            F.when(event == DONE, F.col("ref")).alias("offer_id"),
            F.when(event == BOUGHT, F.col("v")).alias("amount"),
            F.when(event == DONE, F.col("v")).alias("reward"),
        ).alias("value"),
    )
