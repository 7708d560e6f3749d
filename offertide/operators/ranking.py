"""Scores and rankings. A ranking is a `rank` column over a total order, best first."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offertide.functions.draws import gumbel, keyed_uniform
from offertide.functions.ranked import Ranked, numbered
from offertide.settings import GRAIN, Settings

TINY = 1e-9


def best_first(score: str = "score", keys: Sequence[str] = GRAIN) -> list[Column]:
    """Higher score first, then the row key: a total order."""
    return [F.desc_nulls_last(score), *[F.asc(k) for k in keys]]


def rank_by(df: DataFrame, score: str, keys: Sequence[str] = GRAIN) -> DataFrame:
    return numbered(df, best_first(score, keys))


def uplift_ranking(df: DataFrame) -> DataFrame:
    return rank_by(df, "uplift")


def conversion_ranking(df: DataFrame) -> DataFrame:
    return rank_by(df, "p_convert")


def hybrid_score(lambda_: float) -> Column:
    """uplift + lambda * p_convert, neither rescaled."""
    return F.expr(f"uplift + {float(lambda_)!r}D * p_convert")


def hybrid_ranking(df: DataFrame, lambda_: float) -> DataFrame:
    return rank_by(df.withColumn("score", hybrid_score(lambda_)), "score")


def add_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Attach `<column>_lo` and `<column>_hi`, the range over the whole frame (one row)."""
    ends = [F.expr(f"{fn}({c}) AS {c}_{end}") for c in columns for fn, end in (("min", "lo"), ("max", "hi"))]
    return df.crossJoin(df.agg(*ends))


def scaled(column: str) -> str:
    """Min-max to [0, 1] over the frame, given the bounds from add_scale."""
    return f"(({column} - {column}_lo) / ({column}_hi - {column}_lo + {TINY!r}D))"


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`<column>_scaled` for every column."""
    return add_scale(df, columns).selectExpr(
        *df.columns, *[f"{scaled(c)} AS {c}_scaled" for c in columns])


def local_weight(gamma: float) -> str:
    """Share of the conversion prior: uncertainty over its maximum, to the power gamma."""
    return f"power(uncertainty / (uncertainty_hi + {TINY!r}D), {float(gamma)!r}D)"


def dynamic_score_sql(gamma: float) -> str:
    weight = local_weight(gamma)
    return f"(1 - {weight}) * {scaled('uplift')} + {weight} * {scaled('p_convert')}"


_DYNAMIC_INPUTS = ("uncertainty", "uplift", "p_convert")


def add_dynamic_score(df: DataFrame, gamma: float = 1.0, name: str = "score_dynamic") -> DataFrame:
    return add_scale(df, _DYNAMIC_INPUTS).selectExpr(*df.columns, f"{dynamic_score_sql(gamma)} AS {name}")


def dynamic_ranking(df: DataFrame, gamma: float = 1.0) -> DataFrame:
    return rank_by(add_dynamic_score(df, gamma, "score"), "score")


def blend_score(df: DataFrame, cfg: Settings, name: str = "score") -> DataFrame:
    """The configured blend on given uplift, p_convert and uncertainty columns."""
    if cfg.blend_mode == "fixed":
        return df.withColumn(name, hybrid_score(cfg.blend_lambda))
    return add_dynamic_score(df, cfg.blend_gamma, name)


def effective_lambda(df: DataFrame, cfg: Settings) -> DataFrame:
    """One row: the fixed weight, or the mean local weight of the dynamic blend."""
    if cfg.blend_mode == "fixed":
        return df.agg(F.expr(f"max({float(cfg.blend_lambda)!r}D) AS effective_lambda"))
    return add_scale(df, ["uncertainty"]).agg(
        F.expr(f"avg({local_weight(cfg.blend_gamma)}) AS effective_lambda"))


def random_ranking(df: DataFrame, seed: int) -> DataFrame:
    """Uniform permutation: order by a keyed hash of the row."""
    return rank_by(df.withColumn("score", keyed_uniform(seed, "random", *GRAIN)), "score")


def softmax_key(df: DataFrame, temperature: float, seed: int, score: str = "score",
                keys: Sequence[str] = GRAIN) -> DataFrame:
    """`order_key`, to be sorted descending.

    Scaled score over temperature plus Gumbel noise draws a permutation with chances
    proportional to exp(score / temperature); temperature 0 keeps the score itself.
    """
    if temperature <= 0:
        return df.withColumn("order_key", F.col(score))
    noise = gumbel(keyed_uniform(seed, "softmax", *keys))
    return (
        add_scale(df, [score])
        .withColumn("order_key", F.expr(f"{scaled(score)} / {float(temperature)!r}D") + noise)
        .select(*df.columns, "order_key")
    )


def softmax_ranking(df: DataFrame, temperature: float, seed: int, score: str = "score",
                    keys: Sequence[str] = GRAIN) -> DataFrame:
    return rank_by(softmax_key(df, temperature, seed, score, keys), "order_key", keys).drop("order_key")


def by_strategy(df: DataFrame, scores: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form: one row per (strategy, row) with that strategy's score."""
    pairs = ", ".join(f"struct('{n}' AS strategy, CAST({sql} AS DOUBLE) AS score)" for n, sql in scores.items())
    return df.selectExpr(*GRAIN, *keep, f"inline(array({pairs}))")


def weight_by_budget(df: DataFrame, gammas: Sequence[float]) -> DataFrame:
    """Mean local weight inside every top-N, for each gamma."""
    bounded = add_scale(df, _DYNAMIC_INPUTS)
    rows = ", ".join(
        f"struct({float(g)!r}D AS gamma, {local_weight(g)} AS weight, {dynamic_score_sql(g)} AS score)"
        for g in gammas)
    long = bounded.selectExpr(*GRAIN, f"inline(array({rows}))")
    ranked = Ranked(long, best_first(), ["gamma"])
    sums = ranked.running(ranked.rows, sums={"n": F.lit(1).cast("long"), "total": F.col("weight")})
    return sums.selectExpr("gamma", "n", "total / n AS mean_weight")
