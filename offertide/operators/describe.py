"""Descriptive tables over the log, the profile and the processed table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offertide.functions.quantiles import exact_quantiles
from offertide.functions.draws import keyed_uniform, poisson_one
from offertide.functions.joins import keyed_join
from offertide.functions.timeline import HotKeys, Run, scan
from offertide.operators import clean
from offertide.operators.features import completions_with_view
from offertide.settings import BOUGHT, GRAIN, Settings

PROFILE_COVARIATES = ("age", "credit_card_limit", "tenure_days", "identity_missing")
PURCHASE_HISTORY = (
    "hist_spend_total", "hist_txn_count", "hist_avg_ticket", "hist_spend_std",
    "hist_recency_days", "hist_frequency", "hist_spend_trend",
)
OFFER_HISTORY = (
    "hist_offers_received", "hist_offers_viewed", "hist_offers_completed",
    "hist_offers_received_bogo", "hist_offers_received_discount", "hist_view_rate",
    "hist_conv_rate_bogo", "hist_conv_rate_discount", "hist_completed_unseen_flag",
    "hist_time_view_to_conv",
)
INSIDE, OUTSIDE = "inside some window", "outside any window"


def _aggs(**sql: str) -> list:
    return [F.expr(f"{s} AS {n}") for n, s in sql.items()]


# Log and sources

def events_over_time(events: DataFrame) -> DataFrame:
    return (events.groupBy("event", F.expr("CAST(floor(time) AS INT) AS day"))
            .agg(F.expr("count(1) AS events")))


def events_by_kind(events: DataFrame) -> DataFrame:
    kinds = events.groupBy("event").agg(*_aggs(events="count(1)", first_day="min(time)"))
    # One row per event kind.
    return kinds.selectExpr("*", "events / sum(events) OVER () AS share")


def volumetry(events: DataFrame, profile_raw: DataFrame, offers: DataFrame, processed: DataFrame) -> DataFrame:
    """Rows, distinct customers and offers per source, and the time span of the log."""
    columns = {"rows": "bigint", "customers": "bigint", "offers": "bigint", "first_time": "double", "last_time": "double"}

    def source(df: DataFrame, name: str, **have: str) -> DataFrame:
        return df.agg(*_aggs(rows="count(1)", **have)).selectExpr(
            f"'{name}' AS source",
            *[f"CAST({c if c == 'rows' or c in have else 'NULL'} AS {t}) AS {c}" for c, t in columns.items()])

    return _stack([
        source(events, "events", customers="count(DISTINCT account_id)", first_time="min(time)", last_time="max(time)"),
        source(profile_raw, "profile", customers="count(DISTINCT id)"),
        source(offers, "offers", offers="count(DISTINCT id)"),
        source(processed, "processed", customers="count(DISTINCT account_id)", offers="count(DISTINCT offer_id)"),
    ])


def catalogue_by_type(offers: DataFrame) -> DataFrame:
    return offers.groupBy("offer_type").agg(*_aggs(
        offers="count(1)", mean_minimum="avg(min_value)", mean_discount="avg(discount_value)",
        mean_duration="avg(duration)"))


def customer_coverage(profile: DataFrame, processed: DataFrame) -> DataFrame:
    return _stack([
        profile.agg(*_aggs(customers="count(DISTINCT account_id)")).selectExpr("'profile' AS source", "customers"),
        processed.agg(*_aggs(customers="count(DISTINCT account_id)")).selectExpr("'processed' AS source", "customers"),
        profile.agg(*_aggs(customers="count_if(identity_missing = 1)")).selectExpr(
            "'identity missing' AS source", "customers"),
    ])


# Waves

def wave_summary(processed: DataFrame) -> DataFrame:
    return (
        processed.groupBy("campaign_wave", "received_time")
        .agg(*_aggs(received="count(1)", viewed="sum(treatment)", converted="sum(converted)"))
        .selectExpr("*", "viewed / received AS view_rate", "converted / received AS conversion_rate",
                    "try_divide(converted, viewed) AS conversion_per_view")
    )


def validity_windows(processed: DataFrame, events: DataFrame) -> DataFrame:
    """How much of each wave's validity lies after the end of the data."""
    end = events.agg(F.expr("max(time) AS end_of_data"))
    waves = (
        processed.groupBy("campaign_wave", "received_time")
        .agg(*_aggs(duration="avg(duration)", received="count(1)"))
        .selectExpr("*", "received_time + duration AS valid_until")
    )
    # A handful of waves; the share over all receipts needs one more row total.
    return waves.crossJoin(end).selectExpr(
        "*", "least(valid_until, end_of_data) AS observable_until",
        "valid_until > end_of_data AS censored",
        "greatest(valid_until - end_of_data, 0D) AS censored_days",
        "IF(valid_until > end_of_data, received, 0L) AS censored_receipts",
    ).selectExpr("*", "censored_receipts / sum(received) OVER () AS censored_share")


def recurrence_by_wave(processed: DataFrame) -> DataFrame:
    return _recurrence(processed, ["campaign_wave"])


def recurrence_by_arm(processed: DataFrame) -> DataFrame:
    return _recurrence(processed, ["offer_type", "treatment"])


def recurrence_by_arm_wide(processed: DataFrame) -> DataFrame:
    """Recurrence among converted, one column per arm."""
    return (
        recurrence_by_arm(processed).groupBy("offer_type").pivot("treatment", [0, 1])
        .agg(F.max("recurrence_per_conversion"))
        .withColumnsRenamed({"0": "not_viewed", "1": "viewed"})
    )


def _recurrence(processed: DataFrame, by: list[str]) -> DataFrame:
    return (
        processed.groupBy(*by)
        .agg(*_aggs(received="count(1)", converted="sum(converted)", recurrent="sum(is_recurrent)"))
        .selectExpr("*", "recurrent / received AS recurrence_rate",
                    "try_divide(recurrent, converted) AS recurrence_per_conversion")
    )


# Completions, windows and coverage

def unseen_completions(events: DataFrame, offers: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Completions without an earlier view per type; a type without completions has a null rate."""
    kinds = offers.selectExpr("id AS offer_id", "offer_type")
    counted = (
        completions_with_view(events, hot).join(kinds, "offer_id", "left").groupBy("offer_type")
        .agg(*_aggs(completed="count(1)", unseen="count_if(last_view IS NULL)"))
    )
    return (
        offers.select("offer_type").distinct().join(counted, "offer_type", "left")
        .selectExpr("offer_type", "coalesce(completed, 0L) AS completed", "coalesce(unseen, 0L) AS unseen")
        .selectExpr("*", "try_divide(unseen, completed) AS unseen_rate")
    )


def spontaneous_share(events: DataFrame, attributed: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Transactions inside and outside the validity of any receipt."""
    edges = attributed.where("valid_until IS NOT NULL").selectExpr(
        "account_id", "inline(array(struct(received_time AS at, 0 AS kind, 1 AS step),"
        " struct(valid_until AS at, 2 AS kind, -1 AS step)))")
    bought = clean.transactions(events).selectExpr("account_id", "txn_time AS at", "1 AS kind", "0 AS step")
    swept = scan(edges.unionByName(bought), ["account_id"], "at ASC, kind ASC",
                 [Run("n_open", "sum", "step")], hot)
    return (
        swept.where("kind = 1")
        .agg(*_aggs(inside="count_if(n_open > 0)", outside="count_if(n_open = 0)"))
        .selectExpr(
            "inside + outside AS total",
            f"inline(array(struct('{OUTSIDE}' AS place, outside AS transactions),"
            f" struct('{INSIDE}' AS place, inside AS transactions)))")
        .selectExpr("place", "transactions", "try_divide(transactions, total) AS fraction")
    )


def window_spend(attributed: DataFrame, events: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Spend and purchases inside each receipt's window, seen or not, shared between receipts.

    Prefix sums at the two ends of the window, subtracted. They are kept in decimal,
    so that nothing is lost when a small window is cut from a long history.
    """
    probes = attributed.where("valid_until IS NOT NULL").selectExpr(
        *GRAIN, "CAST(NULL AS DECIMAL(18, 6)) AS amount",
        "inline(array(struct(received_time AS at, 0 AS kind, -1 AS sign),"
        " struct(valid_until AS at, 2 AS kind, 1 AS sign)))")
    bought = clean.transactions(events).selectExpr(
        "account_id", "CAST(NULL AS STRING) AS offer_id", "CAST(NULL AS DOUBLE) AS received_time",
        "CAST(txn_amount AS DECIMAL(18, 6)) AS amount", "txn_time AS at", "1 AS kind", "0 AS sign")
    runs = [Run("spent", "sum", "amount"), Run("bought", "count", "amount")]
    swept = scan(probes.unionByName(bought), ["account_id"], "at ASC, kind ASC", runs, hot)
    ends = swept.where("kind <> 1").groupBy(*GRAIN).agg(
        F.expr("coalesce(max_by(spent, sign), 0) - coalesce(min_by(spent, sign), 0) AS spent"),
        F.expr("max_by(bought, sign) - min_by(bought, sign) AS bought"),
    )
    return attributed.select(*GRAIN).join(ends, list(GRAIN), "left").selectExpr(
        *GRAIN, "coalesce(CAST(spent AS DOUBLE), 0D) AS window_spend", "coalesce(bought, 0L) AS window_txns")


def naive_spend_lift(processed: DataFrame, window: DataFrame, segments: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Raw difference of window spend between viewers and non-viewers, per segment."""
    spent = processed.select(*GRAIN, "treatment").join(window, list(GRAIN))
    joined = keyed_join(spent, segments.select("account_id", "segment"), "account_id", hot, "inner")
    return joined.groupBy("segment").agg(*_aggs(
        spend_viewed="avg(CASE WHEN treatment = 1 THEN window_spend END)",
        spend_not_viewed="avg(CASE WHEN treatment = 0 THEN window_spend END)",
        sends_viewed="count_if(treatment = 1)", sends_not_viewed="count_if(treatment = 0)",
    )).selectExpr("*", "spend_viewed - spend_not_viewed AS raw_difference")


def type_coverage(processed: DataFrame, profile: DataFrame) -> DataFrame:
    """Customers who were never sent each offer type."""
    total = profile.agg(*_aggs(customers="count(DISTINCT account_id)"))
    sent = processed.groupBy("offer_type").agg(*_aggs(reached="count(DISTINCT account_id)"))
    return sent.crossJoin(total).selectExpr(
        "offer_type", "customers", "reached", "customers - reached AS never_reached",
        "reached / customers AS coverage")


def conversion_by_tenure(processed: DataFrame, profile: DataFrame, cfg: Settings) -> DataFrame:
    """Conversion per type and tenure quartile of the customer base."""
    cuts = exact_quantiles(profile, {"tenure": "tenure_days"}, (0.25, 0.5, 0.75)).agg(F.first("q").alias("cuts"))
    band = ("CASE WHEN tenure_days IS NULL THEN NULL WHEN tenure_days <= cuts[0] THEN 'Q1' WHEN tenure_days <= cuts[1] THEN 'Q2'"
            " WHEN tenure_days <= cuts[2] THEN 'Q3' ELSE 'Q4' END AS tenure_band")
    return (
        processed.select("offer_type", "tenure_days", "treatment", "converted").crossJoin(cuts)
        .groupBy("offer_type", F.expr(band))
        .agg(*_aggs(received="count(1)", viewed="sum(treatment)", converted="sum(converted)"))
        .selectExpr("*", "converted / received AS conversion_rate", "viewed / received AS view_rate",
                    "try_divide(converted, viewed) AS conversion_per_view")
    )


# Distributions

def numeric_histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width buckets without nulls; a constant column gives one bucket at its value."""
    values = df.selectExpr(f"CAST({column} AS DOUBLE) AS v").where("v IS NOT NULL")
    bounds = values.agg(*_aggs(lo="min(v)", hi="max(v)"))
    bucket = f"IF(hi = lo, 0L, least(floor((v - lo) / ((hi - lo) / {bins})), {bins - 1}L))"
    center = f"IF(max(hi) = min(lo), min(lo), min(lo) + (bucket + 0.5D) * ((max(hi) - min(lo)) / {bins}))"
    return (
        values.crossJoin(bounds).selectExpr("lo", "hi", f"{bucket} AS bucket").groupBy("bucket")
        .agg(*_aggs(center=center, rows="count(1)")).select("center", "rows")
    )


def discount_share_histogram(processed: DataFrame, bins: int) -> DataFrame:
    """Histogram of discount over margin inside each paid type."""
    share = (
        clean.paid_types_only(processed).where("converted = 1 AND conversion_value - reward_cost > 0")
        .selectExpr("offer_type", "reward_cost / (conversion_value - reward_cost) AS v")
    )
    bounds = share.groupBy("offer_type").agg(*_aggs(lo="min(v)", hi="max(v)"))
    bucket = f"IF(hi = lo, 0L, least(floor((v - lo) / ((hi - lo) / {bins})), {bins - 1}L))"
    center = f"IF(max(hi) = min(lo), min(lo), min(lo) + (bucket + 0.5D) * ((max(hi) - min(lo)) / {bins}))"
    return (
        share.join(F.broadcast(bounds), "offer_type")  # one row per paid type
        .selectExpr("offer_type", "lo", "hi", f"{bucket} AS bucket").groupBy("offer_type", "bucket")
        .agg(*_aggs(center=center, rows="count(1)")).select("offer_type", "center", "rows")
    )


def _double(value: float | None) -> str:
    return f"CAST('{value!r}' AS DOUBLE)" if value is not None else "CAST(NULL AS DOUBLE)"


def numeric_profile(df: DataFrame, columns: Sequence[str], cfg: Settings) -> DataFrame:
    """Counts, moments, exact quantiles and Tukey outliers per column."""
    points = (0.01, 0.25, 0.5, 0.75, 0.99)
    found = {r["name"]: r["q"] for r in exact_quantiles(df, {c: c for c in columns}, points).collect()}  # a row per column
    k = cfg.outlier_iqr_multiplier
    measures = []
    for i, c in enumerate(columns):
        measures.append(F.expr(
            f"struct(count({c}) AS n, count(1) AS total, count_if({c} = 0) AS zeros, avg({c}) AS mean,"
            f" stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi,"
            f" array({', '.join(_double(v) for v in found.get(c, [None] * len(points)))}) AS q) AS s{i}"))
    stats = df.agg(*measures)

    def fence(i: int, side: str) -> str:
        spread = f"{k!r}D * (s{i}.q[3] - s{i}.q[1])"
        return f"s{i}.q[1] - {spread}" if side == "low" else f"s{i}.q[3] + {spread}"

    fences = stats.selectExpr(*[
        f"{fence(i, side)} AS {side}{i}" for i in range(len(columns)) for side in ("low", "high")])
    outside = df.select(*columns).crossJoin(fences).agg(*[
        F.expr(f"count_if({c} < low{i} OR {c} > high{i}) AS out{i}") for i, c in enumerate(columns)])
    rows = ", ".join(
        f"struct('{c}' AS column, s{i}.n AS n, s{i}.total - s{i}.n AS nulls,"
        f" try_divide(s{i}.total - s{i}.n, s{i}.total) AS null_fraction, s{i}.zeros AS zeros,"
        f" try_divide(s{i}.zeros, s{i}.n) AS zero_fraction, s{i}.mean AS mean, s{i}.std AS std,"
        f" s{i}.lo AS min, s{i}.q[0] AS p1, s{i}.q[1] AS p25, s{i}.q[2] AS p50, s{i}.q[3] AS p75,"
        f" s{i}.q[4] AS p99, s{i}.hi AS max, out{i} AS outliers, try_divide(out{i}, s{i}.n) AS outlier_fraction)"
        for i, c in enumerate(columns))
    return stats.crossJoin(outside).selectExpr(f"inline(array({rows}))")


def categorical_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count and share per level of each column."""
    levels = ", ".join(f"struct('{c}' AS column, CAST({c} AS STRING) AS level)" for c in columns)
    counted = (
        df.selectExpr(f"inline(array({levels}))").groupBy("column", "level").agg(*_aggs(rows="count(1)"))
    )
    totals = counted.groupBy("column").agg(*_aggs(total="sum(rows)"))
    return counted.join(totals, "column").selectExpr("column", "level", "rows", "rows / total AS share")


BLOCK = 2
"""Columns in a block of the correlation matrix. Larger blocks give updates too long to be compiled."""


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r of every ordered pair over the rows that have both; null if one of them is constant there.

    Columns are cut in blocks, and each row goes to the pairs of blocks, where one aggregation of
    fixed size sums the co-moments of all pairs of their columns. So rows are read once, a task sends
    one row per pair of blocks, and the generated code doesn't grow with the number of columns.
    """
    blocks = -(-len(columns) // BLOCK)
    padded = [f"CAST({c} AS DOUBLE)" for c in columns] + ["CAST(NULL AS DOUBLE)"] * (blocks * BLOCK - len(columns))
    places = range(BLOCK)
    cells = [(p, q) for p in places for q in places]
    dealt = (
        df.selectExpr(f"array({', '.join(padded)}) AS v", f"explode(sequence(0, {blocks - 1})) AS i")
        .selectExpr("v", "i", f"explode(sequence(i, {blocks - 1})) AS j")
        .selectExpr("i", "j", *[f"v[{BLOCK} * i + {p}] AS x{p}" for p in places], *[f"v[{BLOCK} * j + {q}] AS y{q}" for q in places])
    )
    sums = dealt.groupBy("i", "j").agg(*[
        F.expr(f"try_divide(regr_sxy(y{q}, x{p}), sqrt(regr_sxx(y{q}, x{p})) * sqrt(regr_syy(y{q}, x{p}))) AS r{p}_{q}")
        for p, q in cells])
    found = ", ".join(f"struct({BLOCK} * i + {p} AS a, {BLOCK} * j + {q} AS b, r{p}_{q} AS r)" for p, q in cells)
    half = sums.selectExpr("i", "j", f"inline(array({found}))")
    # Pairs within one block come in both orders already.
    both = half.selectExpr("inline(IF(i < j, array(struct(a, b, r), struct(b AS a, a AS b, r)), array(struct(a, b, r))))")
    names = "array({})".format(", ".join(f"'{c}'" for c in columns))
    return both.where(f"a < {len(columns)} AND b < {len(columns)}").selectExpr(
        f"{names}[a] AS feature_a", f"{names}[b] AS feature_b", "a", "b", "r")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per feature, one column per feature."""
    pairs = correlation_pairs(df, columns)
    return pairs.groupBy("feature_a").agg(*[
        F.expr(f"max(CASE WHEN feature_b = '{c}' THEN r END) AS {c}") for c in columns
    ]).withColumnRenamed("feature_a", "feature")


def redundant_pairs(pairs: DataFrame, cfg: Settings) -> DataFrame:
    return pairs.where(f"a < b AND abs(r) >= {cfg.correlation_threshold!r}").selectExpr(
        "feature_a", "feature_b", "r", "abs(r) AS abs_r")


# Balance

def _covariates(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Numeric columns to compare: the given ones and one indicator per gender level."""
    levels = sorted(r[0] for r in df.select("gender").distinct().collect() if r[0] is not None)
    indicators = [f"CAST(gender = '{g}' AS DOUBLE) AS `gender={g}`" for g in levels]
    return df.selectExpr("*", *indicators), [*names, *[f"gender={g}" for g in levels]]


def _moments_long(df: DataFrame, by: str, names: Sequence[str]) -> DataFrame:
    """(group, covariate, mean, var), one pass over the rows."""
    aggs = [F.expr(f"struct(avg(`{c}`) AS mean, coalesce(var_samp(`{c}`), 0D) AS var) AS m{i}")
            for i, c in enumerate(names)]
    rows = ", ".join(f"struct('{c}' AS covariate, m{i}.mean AS mean, m{i}.var AS var)" for i, c in enumerate(names))
    return df.groupBy(by).agg(*aggs).selectExpr(by, f"inline(array({rows}))")


def covariate_balance(processed: DataFrame, cfg: Settings, group: str = "treatment") -> DataFrame:
    """Standardised mean difference of group 1 against group 0 for every covariate."""
    wide, names = _covariates(processed, (*PROFILE_COVARIATES, *PURCHASE_HISTORY, *OFFER_HISTORY))
    stats = _moments_long(wide, group, names)
    both = stats.groupBy("covariate").agg(*_aggs(
        mean_treated=f"max(CASE WHEN {group} = 1 THEN mean END)",
        mean_control=f"max(CASE WHEN {group} = 0 THEN mean END)",
        pooled="sqrt(sum(var) / 2)",
    ))
    smd = ("CASE WHEN pooled > 0 THEN (mean_treated - mean_control) / pooled"
           " WHEN mean_treated = mean_control THEN 0D"
           " WHEN mean_treated > mean_control THEN double('Infinity')"
           " WHEN mean_treated < mean_control THEN double('-Infinity') END AS smd")
    return both.selectExpr("covariate", "mean_treated", "mean_control", smd).selectExpr(
        "*", "abs(smd) AS abs_smd", f"abs(smd) > {cfg.smd_threshold!r} AS above_threshold")


def balance_index(balance: DataFrame) -> DataFrame:
    """Treated mean as an index with control = 100, for finite differences."""
    tiny = "1e-9D"
    return balance.where("abs_smd < double('Infinity')").selectExpr(
        "covariate", "abs_smd", "100D AS control_index",
        f"CASE WHEN abs(mean_control) > {tiny} THEN 100 * mean_treated / mean_control"
        f" WHEN abs(mean_treated) < {tiny} THEN 100D END AS treated_index").where("treated_index IS NOT NULL")


def assignment_balance(processed: DataFrame, cfg: Settings) -> DataFrame:
    """Worst absolute difference over all pairs of offers, per profile covariate.

    A pair's difference grows as its higher mean rises, its lower mean falls or a variance falls. So the worst
    pair is found among the offers that no other one beats in both mean and variance, on the high and on the low
    side, without forming the pairs of all offers. Offers without variance count only against others with
    some, so each side has a front of either kind.
    """
    wide, names = _covariates(processed, PROFILE_COVARIATES)
    stats = _moments_long(wide, "offer_id", names)  # offers x covariates rows
    known = stats.where("mean IS NOT NULL").selectExpr("covariate", "mean", "var", "var > 0 AS varies")
    high = _front(known, "mean").selectExpr("covariate", "mean AS mean_a", "var AS var_a")
    low = _front(known, "-mean").selectExpr("covariate", "mean AS mean_b", "var AS var_b")
    worst = high.join(low, "covariate").where("mean_a > mean_b AND var_a + var_b > 0").groupBy("covariate").agg(
        F.expr("max((mean_a - mean_b) / sqrt((var_a + var_b) / 2)) AS d"))
    return stats.groupBy("covariate").agg(F.count("*").alias("offers")).where("offers > 1").join(worst, "covariate", "left").selectExpr(
        "covariate", "coalesce(d, 0D) AS worst_abs_smd", f"coalesce(d, 0D) > {cfg.smd_threshold!r} AS above_threshold")


def _front(stats: DataFrame, height: str) -> DataFrame:
    """Rows that no row of their covariate and kind beats in height and variance: fronts of parts, then of those."""
    part = F.pmod(F.xxhash64("mean", "var"), F.lit(64))
    rows = stats.selectExpr("*", f"{height} AS _height").withColumn("_part", part)
    for keys in (["covariate", "varies", "_part"], ["covariate", "varies"]):
        higher = Window.partitionBy(*keys).orderBy(F.desc("_height"), F.asc("var")).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_least", F.min("var").over(higher)).where("_least IS NULL OR var < _least").drop("_least")
    return rows.drop("_height", "_part")


# Response and economics

def arm_comparison(processed: DataFrame) -> DataFrame:
    return processed.groupBy("treatment").agg(*_aggs(
        received="count(1)", conversion_rate="avg(converted)",
        mean_ticket="avg(CASE WHEN converted = 1 THEN conversion_value END)",
        mean_revenue="avg(conversion_value)",
    ))


def arm_type_response(processed: DataFrame) -> DataFrame:
    return processed.groupBy("treatment", "offer_type").agg(*_aggs(
        received="count(1)", converted="sum(converted)", revenue="sum(conversion_value)", cost="sum(reward_cost)",
    )).selectExpr("*", "converted / received AS conversion_rate")


def arm_conversion_table(processed: DataFrame) -> DataFrame:
    """2 x 2 of arm and conversion with the rate of each arm."""
    return (
        processed.groupBy("treatment").pivot("converted", [0, 1]).agg(F.count(F.lit(1)))
        .selectExpr("treatment", "coalesce(`0`, 0L) AS not_converted", "coalesce(`1`, 0L) AS converted")
        .selectExpr("*", "converted / (converted + not_converted) AS conversion_rate")
    )


def ticket_by_conversion(processed: DataFrame, cfg: Settings, column: str = "conversion_value",
                         replicates: int | None = None) -> DataFrame:
    """Mean of a column by conversion status, with a percentile bootstrap interval.

    Each row draws a Poisson(1) weight per replicate from its key, so the resamples
    need no shuffle of rows: only weighted sums per replicate leave a task.
    """
    n = replicates or cfg.gain_curve_n_bootstrap
    tail = (1 - cfg.gain_curve_confidence_level) / 2
    rows = processed.selectExpr(*GRAIN, "converted", f"CAST({column} AS DOUBLE) AS v").where("v IS NOT NULL")
    point = rows.groupBy("converted").agg(*_aggs(received="count(1)", mean="avg(v)"))
    draws = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn(
        "weight", poisson_one(keyed_uniform(cfg.seed, "poisson", "replicate", *GRAIN)))
    means = draws.groupBy("converted", "replicate").agg(
        F.expr("try_divide(sum(weight * v), sum(weight)) AS m"))
    band = means.groupBy("converted").agg(
        F.expr(f"percentile(m, {tail!r}) AS mean_lo"), F.expr(f"percentile(m, {1 - tail!r}) AS mean_hi"))
    return point.join(band, "converted", "left")


def response_funnel(processed: DataFrame) -> DataFrame:
    """Received, viewed, converted, recurrent per type with every rate and the margin per send."""
    return (
        processed.groupBy("offer_type")
        .agg(*_aggs(received="count(1)", viewed="sum(treatment)", converted="sum(converted)",
                    recurrent="sum(is_recurrent)", revenue="sum(conversion_value)", cost="sum(reward_cost)"))
        .selectExpr(
            "*", "viewed / received AS view_rate", "converted / received AS conversion_rate",
            "try_divide(converted, viewed) AS conversion_per_view",
            "recurrent / received AS recurrence_rate",
            "try_divide(recurrent, converted) AS recurrence_per_conversion",
            "(revenue - cost) / received AS margin_per_send")
    )


def discount_over_margin(processed: DataFrame, cfg: Settings) -> DataFrame:
    """Discount over margin per type among conversions: mean, median and weighted ratio."""
    margin = "conversion_value - reward_cost"
    share = f"CASE WHEN {margin} > 0 THEN reward_cost / ({margin}) END"
    converted = processed.where("converted = 1")
    medians = exact_quantiles(converted, {"share": share}, (0.5,), ["offer_type"]).selectExpr(
        "offer_type AS _type", "q[0] AS median_share")
    sums = converted.groupBy("offer_type").agg(*_aggs(
        conversions="count(1)", revenue="sum(conversion_value)", cost="sum(reward_cost)",
        mean_value="avg(conversion_value)", mean_cost="avg(reward_cost)", mean_share=f"avg({share})"))
    return (
        sums.join(medians, F.col("offer_type").eqNullSafe(F.col("_type")), "left").drop("_type")
        .selectExpr("*", "mean_value - mean_cost AS mean_margin", "revenue - cost AS total_margin",
                    "try_divide(cost, revenue - cost) AS weighted_share")
    )


def economics_by_arm(processed: DataFrame) -> DataFrame:
    return (
        processed.groupBy("offer_type", "treatment")
        .agg(*_aggs(received="count(1)", converted="sum(converted)", revenue="sum(conversion_value)",
                    cost="sum(reward_cost)"))
        .selectExpr("*", "revenue - cost AS margin", "(revenue - cost) / received AS margin_per_send",
                    "CASE WHEN converted > 0 THEN revenue / converted END AS ticket")
    )


def margin_by_wave(processed: DataFrame) -> DataFrame:
    return (
        processed.groupBy("campaign_wave", "offer_type")
        .agg(*_aggs(received="count(1)", revenue="sum(conversion_value)", cost="sum(reward_cost)"))
        .selectExpr("*", "(revenue - cost) / received AS margin_per_send")
    )


def cell_counts(processed: DataFrame) -> DataFrame:
    return processed.groupBy("offer_type", "treatment", "converted", "campaign_wave").agg(*_aggs(rows="count(1)"))


def ordered_sample(processed: DataFrame, n: int = 5) -> DataFrame:
    """The first rows in (wave, account, offer) order: a top-n, not a full sort."""
    return processed.orderBy("campaign_wave", "account_id", "offer_id").limit(n)


def label_by_arm(df: DataFrame) -> DataFrame:
    """Outcome per type and arm over the full type x arm grid."""
    counted = df.groupBy("offer_type").agg(*_aggs(
        n0="count_if(treatment = 0)", n1="count_if(treatment = 1)",
        y0="coalesce(sum(IF(treatment = 0, converted, 0)), 0)",
        y1="coalesce(sum(IF(treatment = 1, converted, 0)), 0)"))
    return counted.selectExpr(
        "offer_type", "inline(array(struct(0 AS treatment, n0 AS n, y0 AS converted),"
        " struct(1 AS treatment, n1 AS n, y1 AS converted)))"
    ).selectExpr("*", "try_divide(converted, n) AS conversion_rate")


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
