"""Features as of a moment: only events strictly before the receipt are used.

All history blocks share one sorted pass per account. Probes (one per account and
moment) are merged with the events; at equal times the probe comes first, so an
event at the moment itself is never seen. A second probe at half the elapsed time
gives the first half of the spend trend.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offertide.functions.timeline import HotKeys, Run, scan
from offertide.operators import clean
from offertide.settings import DONE, GRAIN, SEEN, SENT

PURCHASES, RESPONSES, UNSEEN, DELAY, ACTIVE = "purchases", "responses", "unseen", "delay", "active"
ALL_BLOCKS = (PURCHASES, RESPONSES, UNSEEN, DELAY, ACTIVE)

BLOCK_COLUMNS = {
    PURCHASES: ("hist_spend_total", "hist_txn_count", "hist_avg_ticket", "hist_spend_std",
                "hist_recency_days", "hist_frequency", "hist_spend_trend"),
    RESPONSES: ("hist_offers_received", "hist_offers_viewed", "hist_offers_completed",
                "hist_offers_received_bogo", "hist_offers_received_discount",
                "hist_offers_received_info", "hist_view_rate", "hist_conv_rate_bogo",
                "hist_conv_rate_discount"),
    UNSEEN: ("hist_completed_unseen_flag",),
    DELAY: ("hist_time_view_to_conv",),
    ACTIVE: ("n_concurrent_offers",),
}

# Order of rows at one moment: an interval that starts now is open, the probe
# looks, then events happen and intervals end.
_OPENS, _LOOKS, _HAPPENS = 0, 1, 2

_ROW = {
    "account_id": "string", "at": "double", "kind": "int", "moment": "double", "half": "boolean",
    "step": "long", "amount": "double", "spent_at": "double",
    "sent": "int", "seen": "int", "done": "int", "offer_type": "string",
    "unseen": "int", "delay": "double",
}


def completions_with_view(events: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Distinct completions with the last view of the same offer at or before them."""
    done = clean.completions(events).distinct().selectExpr(
        "account_id", "offer_id", "completed_time AS at", "1 AS kind"
    )
    seen = clean.views(events).selectExpr("account_id", "offer_id", "view_time AS at", "0 AS kind")
    runs = [Run("last_view", "max", "CASE WHEN kind = 0 THEN at END")]
    swept = scan(done.unionByName(seen), ["account_id", "offer_id"], "at ASC, kind ASC", runs, hot)
    return swept.where("kind = 1").selectExpr("account_id", "offer_id", "at AS completed_time", "last_view")


def history(grain: DataFrame, events: DataFrame, offers: DataFrame,
            blocks: tuple[str, ...] = ALL_BLOCKS, receipts: DataFrame | None = None,
            hot: HotKeys | None = None) -> DataFrame:
    """One row per distinct (account, received_time) of `grain` with the chosen blocks.

    `receipts` are the intervals counted as concurrent; by default the rows of
    `grain` itself.
    """
    halves = "array(false, true)" if PURCHASES in blocks else "array(false)"
    # Offers sent together share a moment; the aggregation below removes the copies, so
    # they need no shuffle of their own here.
    looks = grain.selectExpr("account_id", "received_time", f"explode({halves}) AS half")
    rows = [_row(looks, "IF(half, received_time / 2, received_time)", _LOOKS,
                 moment="received_time", half="half")]
    if PURCHASES in blocks:
        bought = clean.transactions(events)
        rows.append(_row(bought, "txn_time", _HAPPENS, amount="txn_amount", spent_at="txn_time"))
    if RESPONSES in blocks:
        rows.append(_response_rows(events, offers))
    if UNSEEN in blocks or DELAY in blocks:
        rows.append(_row(
            completions_with_view(events, hot), "completed_time", _HAPPENS,
            unseen="IF(last_view IS NULL, 1, 0)", delay="completed_time - last_view",
        ))
    if ACTIVE in blocks:
        rows.append(_interval_rows(grain if receipts is None else receipts, offers))

    runs = [r for b in blocks for r in _RUNS[b]]
    swept = scan(reduce(DataFrame.unionByName, rows), ["account_id"], "at ASC, kind ASC", runs, hot)
    # Plain columns, not structs, keep this a hash aggregation.
    picked = [f"max(IF(half, NULL, {r.name})) AS {r.name}" for r in runs if r.kind != "moments"]
    if PURCHASES in blocks:
        picked += [f"max(IF(half, NULL, spend.{m})) AS spend_{m}" for m in ("n", "s", "m2")]
        picked += [f"max(IF(half, spend.{m}, NULL)) AS early_{m}" for m in ("n", "s")]
    at_moment = (
        swept.where(f"kind = {_LOOKS}")
        .groupBy("account_id", F.col("moment").alias("received_time"))
        .agg(*[F.expr(p) for p in picked])
    )
    return at_moment.selectExpr("account_id", "received_time", *[c for b in blocks for c in _FINISH[b]])


def offer_terms(base: DataFrame, offers: DataFrame) -> DataFrame:
    """Catalogue columns of the sent offer: money terms, duration and channels."""
    terms = offers.selectExpr(
        "id AS offer_id",
        "CAST(discount_value AS DOUBLE) AS discount_value",
        "CAST(min_value AS DOUBLE) AS min_value",
        "CAST(duration AS DOUBLE) AS duration",
        "CAST(size(channels) AS INT) AS n_channels",
        *[f"CAST(array_contains(channels, '{c}') AS INT) AS channel_{c}"
          for c in ("web", "email", "mobile", "social")],
        "IF(min_value > 0, CAST(discount_value AS DOUBLE) / min_value, 0D) AS discount_to_minvalue_ratio",
    )
    return base.join(terms, "offer_id", "left")


def add_features(events: DataFrame, base: DataFrame, offers: DataFrame,
                 blocks: tuple[str, ...] = ALL_BLOCKS, receipts: DataFrame | None = None,
                 grain: DataFrame | None = None, hot: HotKeys | None = None) -> DataFrame:
    """`base` with catalogue columns and every history block as of its receipt time.

    `grain` may name a cheaper plan with the same receipts as `base`, so that an
    expensive `base` is computed only once.
    """
    past = history(base if grain is None else grain, events, offers, blocks, receipts, hot)
    out = offer_terms(base, offers).join(past, ["account_id", "received_time"], "left")
    if ACTIVE in blocks and receipts is None:
        # The row's own interval is open too, unless its offer is unknown.
        itself = F.when(F.col("duration").isNotNull(), 1).otherwise(0)
        out = out.withColumn("n_concurrent_offers", (F.col("n_concurrent_offers") - itself).cast("int"))
    return out


def history_block(base: DataFrame, events: DataFrame, offers: DataFrame, block: str,
                  hot: HotKeys | None = None) -> DataFrame:
    """One block on the grain, for use on its own."""
    grain = base.select(*GRAIN)
    return add_features(events, grain, offers, (block,), hot=hot).select(*GRAIN, *BLOCK_COLUMNS[block])


def _row(df: DataFrame, at: str, kind: int | str, **have: str) -> DataFrame:
    have = {"account_id": "account_id", "at": at, "kind": str(kind), **have}
    return df.selectExpr(*[f"CAST({have.get(c, 'NULL')} AS {t}) AS {c}" for c, t in _ROW.items()])


def _response_rows(events: DataFrame, offers: DataFrame) -> DataFrame:
    kinds = offers.selectExpr("id AS offer_ref", "offer_type AS kind_of_offer")
    touched = events.where(F.col("event").isin(SENT, SEEN, DONE)).join(kinds, "offer_ref", "left")
    return _row(
        touched, "time", _HAPPENS, offer_type="kind_of_offer",
        sent=f"IF(event = '{SENT}', 1, 0)", seen=f"IF(event = '{SEEN}', 1, 0)",
        done=f"IF(event = '{DONE}', 1, 0)",
    )


def _interval_rows(receipts: DataFrame, offers: DataFrame) -> DataFrame:
    """+1 where validity starts and -1 after it ends."""
    spans = offers.selectExpr("id AS offer_id", "CAST(duration AS DOUBLE) AS span")
    edges = receipts.select(*GRAIN).join(spans, "offer_id").where("span IS NOT NULL").selectExpr(
        "account_id",
        f"inline(array(struct(received_time AS at, {_OPENS} AS kind, 1 AS step),"
        f" struct(received_time + span AS at, {_HAPPENS} AS kind, -1 AS step)))",
    )
    return _row(edges, "at", "kind", step="step")


def _typed(column: str, kind: str) -> str:
    return f"CASE WHEN offer_type = '{kind}' THEN {column} END"


_RUNS = {
    PURCHASES: [Run("spend", "moments", "amount"), Run("last_spend", "max", "spent_at")],
    RESPONSES: [
        Run("n_sent", "sum", "sent"), Run("n_seen", "sum", "seen"), Run("n_done", "sum", "done"),
        Run("n_sent_bogo", "sum", _typed("sent", "bogo")),
        Run("n_sent_discount", "sum", _typed("sent", "discount")),
        Run("n_sent_info", "sum", _typed("sent", "informational")),
        Run("n_done_bogo", "sum", _typed("done", "bogo")),
        Run("n_done_discount", "sum", _typed("done", "discount")),
    ],
    UNSEEN: [Run("any_unseen", "max", "unseen")],
    DELAY: [Run("delay_sum", "sum", "delay"), Run("delay_n", "count", "delay")],
    ACTIVE: [Run("n_open", "sum", "step")],
}

_FINISH = {
    PURCHASES: [
        "spend_s AS hist_spend_total",
        "CAST(spend_n AS INT) AS hist_txn_count",
        "IF(spend_n > 0, spend_s / spend_n, 0D) AS hist_avg_ticket",
        "IF(spend_n > 1, sqrt(spend_m2 / (spend_n - 1)), 0D) AS hist_spend_std",
        "received_time - last_spend AS hist_recency_days",
        "IF(received_time > 0, spend_n / received_time, 0D) AS hist_frequency",
        "IF(spend_n > early_n, (spend_s - early_s) / (spend_n - early_n), 0D)"
        " - IF(early_n > 0, early_s / early_n, 0D) AS hist_spend_trend",
    ],
    RESPONSES: [
        "CAST(coalesce(n_sent, 0) AS INT) AS hist_offers_received",
        "CAST(coalesce(n_seen, 0) AS INT) AS hist_offers_viewed",
        "CAST(coalesce(n_done, 0) AS INT) AS hist_offers_completed",
        "CAST(coalesce(n_sent_bogo, 0) AS INT) AS hist_offers_received_bogo",
        "CAST(coalesce(n_sent_discount, 0) AS INT) AS hist_offers_received_discount",
        "CAST(coalesce(n_sent_info, 0) AS INT) AS hist_offers_received_info",
        "IF(n_sent > 0, coalesce(n_seen, 0) / n_sent, 0D) AS hist_view_rate",
        "IF(n_sent_bogo > 0, coalesce(n_done_bogo, 0) / n_sent_bogo, 0D) AS hist_conv_rate_bogo",
        "IF(n_sent_discount > 0, coalesce(n_done_discount, 0) / n_sent_discount, 0D)"
        " AS hist_conv_rate_discount",
    ],
    UNSEEN: ["coalesce(any_unseen, 0) AS hist_completed_unseen_flag"],
    DELAY: ["IF(delay_n > 0, delay_sum / delay_n, NULL) AS hist_time_view_to_conv"],
    ACTIVE: ["CAST(coalesce(n_open, 0) AS INT) AS n_concurrent_offers"],
}
