"""The fixed schema of the processed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

# Column order, types and nullability of the processed table.
PROCESSED_SCHEMA = StructType([
    StructField("account_id", StringType(), False),
    StructField("offer_id", StringType(), False),
    StructField("offer_type", StringType(), False),
    StructField("received_time", DoubleType(), False),
    StructField("campaign_wave", IntegerType(), False),
    StructField("treatment", IntegerType(), False),
    StructField("converted", IntegerType(), False),
    StructField("conversion_value", DoubleType(), False),
    StructField("reward_cost", DoubleType(), False),
    StructField("is_recurrent", IntegerType(), False),
    StructField("age", IntegerType(), True),
    StructField("gender", StringType(), False),
    StructField("credit_card_limit", DoubleType(), True),
    StructField("identity_missing", IntegerType(), False),
    StructField("tenure_days", IntegerType(), False),
    StructField("hist_spend_total", DoubleType(), False),
    StructField("hist_txn_count", IntegerType(), False),
    StructField("hist_avg_ticket", DoubleType(), False),
    StructField("hist_spend_std", DoubleType(), False),
    StructField("hist_recency_days", DoubleType(), True),
    StructField("hist_frequency", DoubleType(), False),
    StructField("hist_spend_trend", DoubleType(), False),
    StructField("hist_offers_received", IntegerType(), False),
    StructField("hist_offers_received_bogo", IntegerType(), False),
    StructField("hist_offers_received_discount", IntegerType(), False),
    StructField("hist_offers_received_info", IntegerType(), False),
    StructField("hist_offers_viewed", IntegerType(), False),
    StructField("hist_offers_completed", IntegerType(), False),
    StructField("hist_view_rate", DoubleType(), False),
    StructField("hist_conv_rate_bogo", DoubleType(), False),
    StructField("hist_conv_rate_discount", DoubleType(), False),
    StructField("hist_completed_unseen_flag", IntegerType(), False),
    StructField("hist_time_view_to_conv", DoubleType(), True),
    StructField("discount_value", DoubleType(), False),
    StructField("min_value", DoubleType(), False),
    StructField("duration", DoubleType(), False),
    StructField("n_channels", IntegerType(), False),
    StructField("channel_web", IntegerType(), False),
    StructField("channel_email", IntegerType(), False),
    StructField("channel_mobile", IntegerType(), False),
    StructField("channel_social", IntegerType(), False),
    StructField("discount_to_minvalue_ratio", DoubleType(), False),
    StructField("n_concurrent_offers", IntegerType(), False),
])
COLUMNS = tuple(f.name for f in PROCESSED_SCHEMA.fields)
NULLABLE = frozenset(f.name for f in PROCESSED_SCHEMA.fields if f.nullable)


def schema_differences(df: DataFrame) -> list[dict]:
    """One record per position at which names or types differ from the contract."""
    have = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    want = [(f.name, f.dataType.simpleString()) for f in PROCESSED_SCHEMA.fields]
    size = max(len(have), len(want))
    have += [(None, None)] * (size - len(have))
    want += [(None, None)] * (size - len(want))
    return [
        {"position": i, "expected": f"{w[0]}:{w[1]}", "found": f"{h[0]}:{h[1]}"}
        for i, (h, w) in enumerate(zip(have, want)) if h != w
    ]


def enforce_schema(df: DataFrame) -> DataFrame:
    """`df` itself if it keeps the contract, else its columns put in order and cast."""
    if not schema_differences(df):
        return df
    absent = set(COLUMNS).difference(df.columns)
    if absent:
        raise ValueError(f"no column for {sorted(absent)} of the contract")
    return df.selectExpr(*[f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in PROCESSED_SCHEMA])


def check_schema(df: DataFrame, strict: bool = False) -> DataFrame:
    """Differences between the schema of `df` and the contract; none means equal."""
    found = schema_differences(df)
    if strict and found:
        raise ValueError(f"schema differs from the contract: {found}")
    return df.sparkSession.createDataFrame(found, "position int, expected string, found string")


def column_report(df: DataFrame) -> DataFrame:
    """Per contract column: expected and found type, filled rows, whether it differs; one pass."""
    found = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wrong = {d["position"] for d in schema_differences(df)}
    rows = ", ".join(
        f"struct({i} AS position, '{f.name}' AS column, '{f.dataType.simpleString()}' AS expected,"
        f" '{found.get(f.name, 'missing')}' AS found, {f.name} AS filled, {str(i in wrong).lower()} AS differs)"
        for i, f in enumerate(PROCESSED_SCHEMA.fields))
    counts = [F.expr(f"count({f.name}) AS {f.name}" if f.name in found else f"0L AS {f.name}")
              for f in PROCESSED_SCHEMA.fields]
    return df.agg(*counts).selectExpr(f"inline(array({rows}))")
