"""From the flattened log to the processed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offertide.functions.joins import keyed_join
from offertide.functions.ranked import numbered
from offertide.functions.storage import small_or_same, written
from offertide.functions.timeline import HotKeys, find_hot_keys
from offertide.operators import clean
from offertide.operators.attribution import add_recurrence_flag, attribute, build_label
from offertide.operators.contract import enforce_schema
from offertide.operators.features import add_features
from offertide.settings import Settings


def campaign_waves(df: DataFrame, cfg: Settings) -> DataFrame:
    """0-based dense rank of the distinct send times.

    Sends come in a handful of waves, ranked on one task; send times too many for
    that are ranked over a range layout instead.
    """
    times, small = small_or_same(df.select("received_time").distinct(), cfg.small_table_rows)
    if small:
        order = Window.orderBy("received_time")
        return times.withColumn("campaign_wave", (F.row_number().over(order) - 1).cast("int"))
    place = numbered(times, [F.asc("received_time")], name="place")
    return place.select("received_time", (F.col("place") - 1).cast("int").alias("campaign_wave"))


def add_campaign_wave(df: DataFrame, waves: DataFrame) -> DataFrame:
    return df.join(waves, "received_time", "left")


def join_profile(df: DataFrame, profile: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Profile columns by account; the rows of a hot account are spread over salts."""
    return keyed_join(df, profile, "account_id", hot)


def label_receipts(events: DataFrame, offers: DataFrame, cfg: Settings,
                   hot: HotKeys | None = None) -> DataFrame:
    """Attributed receipts with label and recurrence."""
    return add_recurrence_flag(build_label(attribute(events, offers, cfg, hot)), cfg, hot)


def assemble(events: DataFrame, offers: DataFrame, profile: DataFrame, cfg: Settings,
             hot: HotKeys | None = None) -> DataFrame:
    """Everything up to, but not including, the projection to the contract."""
    labelled = label_receipts(events, offers, cfg, hot)
    featured = add_features(events, labelled, offers, grain=clean.receipts(events), hot=hot)
    priced = clean.add_reward_cost(featured, offers)
    treated = clean.add_treatment(join_profile(priced, profile, hot))
    return add_campaign_wave(treated, campaign_waves(clean.receipts(events), cfg))


def build_processed(events: DataFrame, offers: DataFrame, profile: DataFrame, cfg: Settings,
                    hot: HotKeys | None = None) -> DataFrame:
    """The processed table in contract form; `profile` is already normalised."""
    return enforce_schema(assemble(events, offers, profile, cfg, hot))


def stage_log(events: DataFrame) -> DataFrame:
    """The flattened log as Parquet by event kind, so that each step reads only its kinds."""
    return written(events, "log", partition_by=["event"])


def hot_accounts(events: DataFrame, cfg: Settings) -> HotKeys | None:
    return find_hot_keys(events, "account_id", "time", cfg.rows_per_task)
