"""Exclusive attribution of views and purchases to sent offers.

A view or purchase at time t belongs to the receipt that wins the priority among
those whose closed validity interval contains t. Offers with equal duration and
equal minimum spend form a class; inside a class the order of the interval starts
is the order of the interval ends, so the winner is a running minimum along the
account's time line. The class is a key of the sweep: a purchase is sent to those
classes that its account holds and whose minimum it meets, and the winner over the classes is
reduced per purchase. So the plan is the same for any catalogue, and one sorted pass
replaces the receipt x purchase pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offertide.functions.joins import keyed_join
from offertide.functions.timeline import HotKeys, Run, scan
from offertide.operators import clean
from offertide.settings import EARLIEST, GRAIN, LATEST, Settings

ATTRIBUTED_COLUMNS = (
    *GRAIN, "valid_until", "view_time",
    "assigned_txn_count", "assigned_txn_amount_sum", "first_assigned_txn_time",
)


def with_validity(received: DataFrame, offers: DataFrame) -> DataFrame:
    """Receipts with minimum spend and the end of their validity (null for unknown offers)."""
    terms = offers.select(
        F.col("id").alias("offer_id"),
        F.col("duration").cast("double").alias("duration"),
        F.col("min_value").cast("double").alias("min_value"),
    )
    return received.join(terms, "offer_id", "left").withColumn(
        "valid_until", F.col("received_time") + F.col("duration")
    )


def priority_order(cfg: Settings) -> str:
    """SQL sort list of competing receipts, best first."""
    first = "received_time ASC" if cfg.attribution_priority == EARLIEST else "received_time DESC"
    return f"{first}, offer_id ASC"


def ranked_receipts(received: DataFrame, cfg: Settings, hot: HotKeys | None = None) -> DataFrame:
    """Position of each receipt in the priority order of its account."""
    return scan(received, ["account_id"], priority_order(cfg), [Run("priority", "count", "1")], hot,
                at="received_time", descending=cfg.attribution_priority == LATEST)


def owned_views(received: DataFrame, viewed: DataFrame, cfg: Settings,
                hot: HotKeys | None = None) -> DataFrame:
    """First view owned by each receipt; a view counts for one receipt of its offer only."""
    begins = received.where("valid_until IS NOT NULL").selectExpr(
        "account_id", "offer_id", f"{_sort_time(cfg)} AS at", "0 AS kind",
        f"{_signed(cfg, 'received_time')} AS start", "duration",
    )
    seen = viewed.selectExpr(
        "account_id", "offer_id", "view_time AS at", "1 AS kind",
        "CAST(NULL AS DOUBLE) AS start", "CAST(NULL AS DOUBLE) AS duration",
    )
    runs = [Run("owner", "min", "start"), Run("span", "max", "duration")]
    swept = _sweep(begins.unionByName(seen), ["account_id", "offer_id"], runs, cfg, hot)
    start = _signed(cfg, "owner")
    return (
        swept.where(f"kind = 1 AND {_contains(cfg, start, 'span')}")
        .groupBy("account_id", "offer_id", F.expr(start).alias("received_time"))
        .agg(F.min("at").alias("view_time"))
    )


def owned_transactions(received: DataFrame, bought: DataFrame, cfg: Settings,
                       hot: HotKeys | None = None) -> DataFrame:
    """Each eligible transaction with the single receipt that owns it.

    The minimum spend is applied before ownership: an offer whose minimum is not
    met never competes for the purchase.
    """
    terms = ["duration", "min_value"]
    begins = received.where("valid_until IS NOT NULL AND min_value IS NOT NULL").selectExpr(
        "account_id", *terms, f"{_sort_time(cfg)} AS at", "0 AS kind", "CAST(NULL AS DOUBLE) AS txn_amount",
        "CAST(NULL AS BIGINT) AS copies",
        f"named_struct('start', {_signed(cfg, 'received_time')}, 'offer_id', offer_id) AS receipt",
    )
    spent = _sent_to(bought, begins.select("account_id", *terms).distinct(), hot).selectExpr(
        "account_id", *terms, "txn_time AS at", "1 AS kind", "txn_amount", "copies",
        "CAST(NULL AS struct<start: double, offer_id: string>) AS receipt",
    )
    swept = _sweep(begins.unionByName(spent), ["account_id", *terms], [Run("best", "min", "receipt")], cfg, hot)
    return (
        swept.where(f"kind = 1 AND {_contains(cfg, _signed(cfg, 'best.start'), 'duration')}")
        .groupBy("account_id", F.col("at").alias("txn_time"), "txn_amount")
        .agg(F.min("best").alias("owner"), F.max("copies").alias("copies"))
        .selectExpr("account_id", "owner.offer_id AS offer_id",
                    f"{_signed(cfg, 'owner.start')} AS received_time", "txn_time", "txn_amount",
                    "explode(sequence(1L, copies)) AS copy").drop("copy")
    )


def _sent_to(bought: DataFrame, held: DataFrame, hot: HotKeys | None) -> DataFrame:
    """Purchases, equal ones counted as copies, for each class of their account whose minimum they meet.

    An account holds at most as many classes as the catalogue has distinct terms.
    """
    distinct = bought.groupBy("account_id", "txn_time", "txn_amount").agg(F.count(F.lit(1)).alias("copies"))
    return keyed_join(distinct, held, "account_id", hot, "inner").where("txn_amount >= min_value")


def first_transactions(owned: DataFrame) -> DataFrame:
    """The first owned purchase of each receipt (smaller amount first at equal times)."""
    return (
        owned.groupBy(*GRAIN)
        .agg(F.min(F.struct("txn_time", "txn_amount")).alias("first"))
        .select(
            *GRAIN, F.lit(1).cast("long").alias("assigned_txn_count"),
            F.col("first.txn_amount").alias("assigned_txn_amount_sum"),
            F.col("first.txn_time").alias("first_assigned_txn_time"),
        )
    )


def candidate_transactions(received: DataFrame, bought: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Transactions with at least one receipt that is valid and whose minimum is met.

    `n_candidates` counts those receipts: per minimum spend, intervals opened minus
    intervals closed along the account's time line.
    """
    known = received.where("valid_until IS NOT NULL AND min_value IS NOT NULL")
    edges = known.selectExpr(
        "account_id", "min_value", "CAST(NULL AS DOUBLE) AS txn_amount", "CAST(NULL AS BIGINT) AS copies",
        "inline(array(named_struct('at', received_time, 'kind', 0, 'step', 1),"
        " named_struct('at', valid_until, 'kind', 2, 'step', -1)))",
    )
    spent = _sent_to(bought, known.select("account_id", "min_value").distinct(), hot).selectExpr(
        "account_id", "min_value", "txn_amount", "copies", "txn_time AS at", "1 AS kind", "CAST(NULL AS INT) AS step",
    )
    swept = scan(edges.unionByName(spent), ["account_id", "min_value"], "at ASC, kind ASC",
                 [Run("n_open", "sum", "step")], hot)
    return (
        swept.where("kind = 1 AND n_open > 0")
        .groupBy("account_id", F.col("at").alias("txn_time"), "txn_amount")
        .agg(F.sum("n_open").alias("n_candidates"), F.max("copies").alias("copies"))
        .selectExpr("account_id", "txn_time", "txn_amount", "n_candidates", "explode(sequence(1L, copies)) AS copy").drop("copy")
    )


def overlap_report(candidates: DataFrame) -> DataFrame:
    """How many transactions more than one receipt competes for."""
    several = F.col("n_candidates") > 1
    return candidates.agg(
        F.count(F.lit(1)).alias("eligible_txns"),
        F.count(F.when(several, 1)).alias("contested_txns"),
        F.coalesce(F.max("n_candidates"), F.lit(0)).alias("most_candidates"),
    )


def attribute(events: DataFrame, offers: DataFrame, cfg: Settings,
              hot: HotKeys | None = None) -> DataFrame:
    """One row per receipt with its first view and its first owned purchase."""
    base = with_validity(clean.receipts(events), offers)
    seen = owned_views(base, clean.views(events), cfg, hot)
    bought = owned_transactions(base, clean.transactions(events), cfg, hot)

    # Receipts, views and purchases meet in one aggregation on the grain. A grain
    # that was sent twice is counted and repeated, as a join would do.
    columns = {"copies": "INT", "valid_until": "DOUBLE", "view_time": "DOUBLE",
               "txn_time": "DOUBLE", "txn_amount": "DOUBLE"}

    def part(df: DataFrame, **have: str) -> DataFrame:
        return df.selectExpr(*GRAIN, *[f"CAST({have.get(c, 'NULL')} AS {t}) AS {c}" for c, t in columns.items()])

    merged = (
        part(base, copies="1", valid_until="valid_until")
        .unionByName(part(seen, view_time="view_time"))
        .unionByName(part(bought, txn_time="txn_time", txn_amount="txn_amount"))
        .groupBy(*GRAIN)
        .agg(
            F.expr("CAST(sum(copies) AS INT) AS copies"),
            F.expr("max(valid_until) AS valid_until"),
            F.expr("min(view_time) AS view_time"),
            F.expr("min(CASE WHEN txn_time IS NOT NULL THEN struct(txn_time, txn_amount) END) AS first"),
        )
    )
    return merged.selectExpr("*", "explode(sequence(1, copies)) AS copy").selectExpr(
        *GRAIN, "valid_until", "view_time",
        "CAST(CASE WHEN first IS NULL THEN 0 ELSE 1 END AS BIGINT) AS assigned_txn_count",
        "coalesce(first.txn_amount, 0D) AS assigned_txn_amount_sum",
        "first.txn_time AS first_assigned_txn_time",
    )


def build_label(df: DataFrame) -> DataFrame:
    """Converted when a purchase is assigned, whether or not the offer was seen."""
    hit = F.col("assigned_txn_count") > 0
    return df.withColumn("converted", F.when(hit, 1).otherwise(0)).withColumn(
        "conversion_value", F.when(hit, F.col("assigned_txn_amount_sum")).otherwise(F.lit(0.0))
    )


def add_recurrence_flag(df: DataFrame, cfg: Settings, hot: HotKeys | None = None) -> DataFrame:
    """1 on a converted row whose account converts again in (t, t + window]."""
    # Kind 0 asks "when next?", kind 1 is the conversion that others may find. Rows that
    # have no conversion stand at their send time, so that a hot account's are cut too.
    rows = df.selectExpr(
        "*", "CASE WHEN converted = 1 THEN first_assigned_txn_time ELSE received_time END AS at",
        "explode(CASE WHEN converted = 1 THEN array(0, 1) ELSE array(0) END) AS kind",
    )
    runs = [Run("next_time", "min", "CASE WHEN kind = 1 THEN at END")]
    swept = scan(rows, ["account_id"], "at DESC, kind ASC", runs, hot, descending=True)
    days = float(cfg.recurrence_window_days)
    return swept.where("kind = 0").selectExpr(
        *df.columns,
        f"CASE WHEN converted = 1 AND next_time <= at + {days!r}D THEN 1 ELSE 0 END AS is_recurrent",
    )


def _signed(cfg: Settings, start: str) -> str:
    """Smaller is better; applied twice it gives the start time back."""
    return f"(-{start})" if cfg.attribution_priority == LATEST else start


def _sort_time(cfg: Settings) -> str:
    return "received_time" if cfg.attribution_priority == LATEST else "valid_until"


def _contains(cfg: Settings, start: str, duration: str) -> str:
    """The half of the interval test that the sweep order has not already decided."""
    return f"{start} + {duration} >= at" if cfg.attribution_priority == LATEST else f"{start} <= at"


def _sweep(rows: DataFrame, keys: list[str], runs: list[Run], cfg: Settings,
           hot: HotKeys | None) -> DataFrame:
    """Latest wins: walk forward over starts. Earliest wins: walk back over ends."""
    back = cfg.attribution_priority == EARLIEST
    order = "at DESC, kind ASC" if back else "at ASC, kind ASC"
    return scan(rows, keys, order, runs, hot, descending=back)

