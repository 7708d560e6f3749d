"""Readers and writers of the raw and the processed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, DoubleType, IntegerType, StringType, StructField, StructType,
)

OFFER_SCHEMA = StructType([
    StructField("id", StringType()),
    StructField("offer_type", StringType()),
    StructField("min_value", DoubleType()),
    StructField("discount_value", DoubleType()),
    StructField("duration", DoubleType()),
    StructField("channels", ArrayType(StringType())),
])

PROFILE_SCHEMA = StructType([
    StructField("id", StringType()),
    StructField("age", IntegerType()),
    StructField("gender", StringType()),
    StructField("credit_card_limit", DoubleType()),
    StructField("registered_on", StringType()),
])

EVENT_SCHEMA = StructType([
    StructField("account_id", StringType()),
    StructField("event", StringType()),
    StructField("time_since_test_start", DoubleType()),
    StructField("value", StructType([
        StructField("offer id", StringType()),
        StructField("offer_id", StringType()),
        StructField("amount", DoubleType()),
        StructField("reward", DoubleType()),
    ])),
])


def read_offers(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return _json(spark, path, OFFER_SCHEMA, multi_line)


def read_profile(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return _json(spark, path, PROFILE_SCHEMA, multi_line)


def read_events(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """JSON Lines by default; `multi_line=True` reads one JSON array per file, unsplit."""
    return _json(spark, path, EVENT_SCHEMA, multi_line)


def _json(spark: SparkSession, path: str | list[str], schema: StructType, multi_line: bool) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


# Names of the flattened log and where the raw log has them, both spellings of a reference.
FLAT_LOG = {
    "account_id": ["account_id"], "event": ["event"], "time": ["time_since_test_start"],
    "offer_ref": ["value.`offer id`", "value.offer_id"], "amount": ["value.amount"], "reward": ["value.reward"],
}
FLAT_SCHEMA = StructType([
    StructField(name, DoubleType() if name in ("time", "amount", "reward") else StringType()) for name in FLAT_LOG])


def parse_events(raw: DataFrame) -> DataFrame:
    """The flattened log: each column is the first of its raw fields that is filled."""
    return raw.select(*[F.coalesce(*fields).alias(name) for name, fields in FLAT_LOG.items()])


def write_processed(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """The processed table; fails unless the files' own schema is the contract's."""
    from offertide.operators.contract import check_schema

    found = spark.read.parquet(path)
    check_schema(found, strict=True)
    return found


def write_recommendations(recommended: DataFrame, path: str) -> None:
    """CSV with a header, in rank order (range-sorted, so file order is rank order)."""
    recommended.orderBy("rank").write.mode("overwrite").csv(path, header=True)


def write_scored_tables(tables: dict[str, DataFrame], path: str) -> None:
    """The published tables (serving matrix, holdout, offers, metadata), one folder each."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
