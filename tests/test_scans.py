"""The two scan primitives against plain windows."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from offertide.functions.draws import fnv_uniform, keyed_uniform, poisson_one
from offertide.functions.ranked import Ranked, numbered, top
from offertide.functions.storage import durable, shared_folder, small_or_same
from offertide.functions.timeline import Run, find_hot_keys, scan


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for i in range(1500):
        # One key holds a third of the rows.
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(60)}"
        value = None if rng.random() < 0.2 else round(rng.uniform(1, 90), 2)
        data.append((key, float(rng.randrange(200)) / 4, i, value))
    return spark.createDataFrame(data, "key string, at double, id int, v double").cache()


RUNS = [Run("s", "sum", "v"), Run("c", "count", "v"), Run("lo", "min", "v"), Run("hi", "max", "v"), Run("m", "moments", "v")]


@pytest.mark.parametrize("descending", [False, True])
def test_hot_keys_are_cut_without_changing_results(rows, descending):
    order = "at DESC, id ASC" if descending else "at ASC, id ASC"
    hot = find_hot_keys(rows, "key", "at", 100)
    assert [r["key"] for r in hot.table.collect()] == ["hot"]
    assert len(hot.table.first()["_cuts"]) >= 5
    plain = {r["id"]: r for r in scan(rows, ["key"], order, RUNS, descending=descending).collect()}
    cut = {r["id"]: r for r in scan(rows, ["key"], order, RUNS, hot, descending=descending).collect()}
    assert plain.keys() == cut.keys()
    for i, a in plain.items():
        b = cut[i]
        for name in ("c", "lo", "hi"):
            assert a[name] == b[name]
        assert a["s"] == pytest.approx(b["s"])
        assert a["m"]["n"] == b["m"]["n"] and a["m"]["m2"] == pytest.approx(b["m"]["m2"], abs=1e-6)


def test_no_key_is_hot_below_the_limit(rows):
    assert find_hot_keys(rows, "key", "at", 10_000) is None


def test_prefix_scan_equals_one_window(rows):
    order = [F.desc("v"), F.asc("id")]
    ranked = Ranked(rows, order, partitions=7)
    got = ranked.running(ranked.rows, {"s": F.coalesce("v", F.lit(0.0)), "n": F.lit(1)}, {"m": F.col("id")})
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("id", F.sum(F.coalesce("v", F.lit(0.0))).over(w).alias("s"), F.row_number().over(w).alias("n"),
                       F.max("id").over(w).alias("m"))
    a = {r["id"]: (round(r["s"], 6), r["n"], r["m"]) for r in got.collect()}
    b = {r["id"]: (round(r["s"], 6), r["n"], r["m"]) for r in want.collect()}
    assert a == b


def test_numbering_per_group_and_top(rows):
    got = numbered(rows, [F.asc("at"), F.asc("id")], ["key"], partitions=5)
    w = Window.partitionBy("key").orderBy("at", "id")
    wrong = got.withColumn("want", F.row_number().over(w)).where("rank <> want").count()
    assert wrong == 0
    head = top(rows, [F.asc("at"), F.asc("id")], 10).collect()
    assert sorted(r["rank"] for r in head) == list(range(1, 11))


def test_draws_do_not_depend_on_partitions(rows):
    u = keyed_uniform(3, "test", "id")
    a = {r[0]: r[1] for r in rows.select("id", u).collect()}
    b = {r[0]: r[1] for r in rows.repartition(9).select("id", u).collect()}
    assert a == b and 0.45 < sum(a.values()) / len(a) < 0.55
    weights = [r[0] for r in rows.select(poisson_one(u)).collect()]
    assert 0.9 < sum(weights) / len(weights) < 1.1


def test_fnv_matches_a_direct_computation(spark):
    def direct(text, seed):
        h = (2166136261 ^ seed) & 0xFFFFFFFF
        for ch in text:
            h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
        return h / 4294967296

    texts = ["a|o1", "customer-17|offer-3", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fnv_uniform(42, F.col("t")).alias("h"))
    assert {r["t"]: r["h"] for r in df.collect()} == {t: direct(t, 42) for t in texts}


def test_small_tables_are_local_and_large_ones_stay(spark):
    df, small = small_or_same(spark.range(5), 10)
    assert small and "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()
    same, small = small_or_same(spark.range(50), 10)
    assert not small and same.count() == 50


def test_checkpoints_use_the_configured_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert durable(spark.range(10)).count() == 10
    assert spark.sparkContext.getCheckpointDir().startswith("file:" + shared_folder(spark))


def test_a_large_side_table_is_not_broadcast_however_small_its_files(spark):
    large, small = small_or_same(spark.range(50).withColumnRenamed("id", "k"), 10)
    plan = spark.range(90).join(large.selectExpr("k AS id"), "id", "left")._jdf.queryExecution().executedPlan().toString()
    assert not small and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_poisson_draws_count_the_steps_reached_without_a_lambda(spark):
    total, term, steps = 0.0, math.exp(-1.0), []
    for k in range(18):
        total += term
        steps.append(total)
        term /= k + 1
    near = [v for s in steps for v in (math.nextafter(s, 0), s, math.nextafter(s, 2))]
    values = [0.0, *near, 1.0, None]
    drawn = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u double").select("i", "u", poisson_one(F.col("u")).alias("w"))
    for r in drawn.collect():
        assert r["w"] == (0 if r["u"] is None else sum(s <= r["u"] for s in steps))
    # A lambda runs uncompiled, at some 30 microseconds a draw.
    assert "lambda" not in drawn._jdf.queryExecution().analyzed().toString()
