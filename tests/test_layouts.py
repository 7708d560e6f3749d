"""Range layouts, quantiles and blocked correlations at several sizes."""

from __future__ import annotations

import math
import random
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from offertide.functions import ranked
from offertide.functions.quantiles import exact_quantiles
from offertide.functions.ranked import PART, Ranked
from offertide.operators import describe

ROWS = 600


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(8)
    data = [(rnd.choice(["a", "b", None]), rnd.randrange(40), k, float(rnd.randrange(-5, 6))) for k in range(ROWS)]
    return data, spark.createDataFrame(data, "g string, s int, k int, v double").repartition(7)


@pytest.mark.parametrize("pieces", [1, 3, 50])
def test_wanted_rows_of_known_pieces_equal_a_plain_scan(rows, monkeypatch, pieces):
    data, df = rows
    stored = {}
    plain = ranked.written
    monkeypatch.setattr(ranked, "written", lambda t, name: stored.setdefault(name, plain(t, name)))
    layout = Ranked(df, [F.asc("k")], ["g"], piece=F.expr(f"k * {pieces} DIV {ROWS}"))
    wanted = [1, 7, 90, 150]
    got = layout.running_maxima({"n": F.lit(1), "t": F.col("v")}, {"top": F.expr("t * 2 - n")}, ["k", "n"], F.col("n").isin(wanted))
    want = {}
    for g in {r[0] for r in data}:
        own = sorted((r for r in data if r[0] == g), key=lambda r: r[2])
        tops = accumulate((2 * t - n for n, t in enumerate(accumulate(r[3] for r in own), 1)), max)
        want |= {r[2]: (n, top) for n, (r, top) in enumerate(zip(own, tops), 1) if n in wanted}
    assert {r["k"]: (r["n"], r["top"]) for r in got.collect()} == want
    assert set(stored) == {"layout", "curve"} and stored["curve"].count() <= 3 * (len(wanted) + pieces)


@pytest.mark.parametrize("piece_rows", [2, 200, 10_000])
def test_running_maxima_equal_a_plain_scan(rows, piece_rows):
    data, df = rows
    layout = Ranked(df, [F.desc("s"), F.asc("k")], ["g"], sized=True, piece_rows=piece_rows)
    pieces = layout.rows.select(PART).distinct().count()
    assert pieces <= 4 if piece_rows > ROWS else pieces >= min(3, ROWS // piece_rows)
    got = layout.running_maxima({"n": F.lit(1), "t": F.col("v")}, {"top": F.expr("t * 2 - n")}, ["k", "n"])
    want = {}
    for g in {r[0] for r in data}:
        own = sorted((r for r in data if r[0] == g), key=lambda r: (-r[1], r[2]))
        tops = accumulate((2 * t - n for n, t in enumerate(accumulate(r[3] for r in own), 1)), max)
        want |= {r[2]: (n, top) for n, (r, top) in enumerate(zip(own, tops), 1)}
    assert {r["k"]: (r["n"], r["top"]) for r in got.collect()} == want


@pytest.mark.parametrize("shuffles", [1, 3, 60])
def test_quantiles_over_any_number_of_pieces(spark, rows, monkeypatch, shuffles):
    from offertide.functions import ranked

    data, df = rows
    monkeypatch.setattr(ranked, "_SMALL_PIECE", max(1, 200 // shuffles))
    monkeypatch.setattr(ranked, "PIECE_ROWS", max(1, 200 // shuffles))
    at = (0.0, 0.1, 0.5, 0.97, 1.0)
    got = {(r["g"], r["name"]): r["q"] for r in exact_quantiles(df, {"s": "s", "v": "IF(v > 0, v, NULL)"}, at, ["g"]).collect()}
    for g in {r[0] for r in data}:
        for name, own in (("s", [r[1] for r in data if r[0] == g]), ("v", [r[3] for r in data if r[0] == g and r[3] > 0])):
            own.sort()
            assert got[g, name] == [own[max(0, math.ceil(q * len(own)) - 1)] for q in at]


@pytest.mark.parametrize("n", [1, 4, 5, 13])
def test_correlations_by_blocks(spark, n):
    rng = np.random.default_rng(n)
    values = rng.normal(size=(80, n)) + rng.normal(size=(80, 1))
    gone = rng.random((80, n)) < 0.2
    values[:, n - 1] = 3.0 if n > 4 else values[:, n - 1]
    names = [f"c{k}" for k in range(n)]
    data = [[None if g else float(v) for v, g in zip(x, y)] for x, y in zip(values, gone)]
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in names)).repartition(4)
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in describe.correlation_pairs(df, names).collect()}
    assert len(got) == n * n
    for i in range(n):
        for j in range(n):
            both = ~gone[:, i] & ~gone[:, j]
            a, b = values[both, i], values[both, j]
            if a.std() == 0 or b.std() == 0:
                assert got[names[i], names[j]] is None
            else:
                assert got[names[i], names[j]] == pytest.approx(np.corrcoef(a, b)[0, 1])


def test_correlation_plan_has_one_aggregation(spark):
    names = [f"c{k}" for k in range(25)]
    df = spark.range(5).selectExpr(*[f"CAST(id * {k} AS DOUBLE) AS {c}" for k, c in enumerate(names)])
    plan = describe.correlation_pairs(df, names)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regr_sxy") <= 2 * describe.BLOCK**2 and describe.correlation_pairs(df, names).count() == 625


def test_correlations_read_the_rows_once(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double").repartition(2)
    plan = describe.correlation_pairs(rows, ["a", "b", "c"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1
