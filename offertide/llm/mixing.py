"""Mixing sources to target weights.

Words are summed per source, targets and repetition rates follow from the sums, and each
document is taken floor(rate) times plus one more copy with the fraction as probability. The
draw is a hash of the document's id. So that a source with a few very long documents doesn't miss
its target by chance, draws are stratified: a source's documents fall into classes of like size, and
each class takes its expected number of extra copies, rounded along the classes from a
start drawn by a hash of the source. The documents of a class with the smallest draws get them.
Every document so has exactly the fraction as its probability, also the only one of its source, and the
number of copies is less than one off in each run of classes from the smallest on.

Null texts have no words. Null sources form a source of their own, the last. Repeated
rows count as they stand and share their draw, as do rows of one class without id: they are taken together. An
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offertide.functions.ranked import Ranked, numbered
from offertide.llm.common import BROADCAST_ROWS, attach_groups, hash_unit, text_or_empty, written

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = 11

_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def word_count(column: str) -> Column:
    """Number of words: each, with the white space around it, becomes one character."""
    text = text_or_empty(column)
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.length(F.regexp_replace(text, _WORD, "."))).otherwise(0).cast("long")


def _source_key(column: str) -> Column:
    """Sorts by code point with null last, and never is null."""
    return F.when(F.col(column).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(column)))


def source_targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """(_source, _n, source_size, target) from rows (_source, size).

    Targets share the total by weight; none is above `most` times its source's size. With
    the sources in order of size over weight, the share per weight left to a source and
    those after it rises until the first source that isn't capped, then falls: the true
    share is the largest. Ranks and sums over sources run over range layouts, so sources
    may be as many as hosts of the web.
    """
    sums = written(sizes.groupBy("_source").agg(
        F.count("*").alias("_n"), F.sum("size").alias("source_size")), "mix-sources")
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = numbered(sums, [F.col("_source")], name="_rank")
    weighed = written(ranked.withColumn(
        "_weight", F.element_at(cycle, ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))).drop("_rank"), "mix-weights")
    layout = Ranked(weighed.where("source_size > 0"),
                    [F.col("source_size") / F.col("_weight"), F.col("_source")])
    run = layout.running(layout.rows, {"_sizes": F.col("source_size"), "_weights": F.col("_weight")})
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_weight"), F.lit(0))).first()
    # Sources without words take no share; their weights count for nobody.
    weight = run.agg(F.coalesce(F.max("_weights"), F.lit(0))).first()[0]
    share = run.agg(F.max(
        (F.lit(total[0]) - most * (F.col("_sizes") - F.col("source_size"))).cast("double")
        / (F.lit(weight) - (F.col("_weights") - F.col("_weight"))).cast("double"))).first()[0]
    return weighed.select("_source", "_n", "source_size", F.least(
        (F.col("source_size") * most).cast("double"), F.lit(float(share or 0.0)) * F.col("_weight")).alias("target"))


def _rates(targets: DataFrame) -> DataFrame:
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return targets.withColumn("_whole", F.floor(rate).cast("long")).withColumn("_part", rate - F.floor(rate))


def _size_class() -> Column:
    """Two classes for each doubling of the size."""
    return F.expr("2 * length(bin(size)) + CAST(shiftright(size, greatest(length(bin(size)) - 2, 0)) & 1 AS INT)")


def _draws(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, *more: Column) -> DataFrame:
    sizes = df.select(*more, _source_key(source_col).alias("_source"), word_count(text_col).alias("size"),
                      hash_unit(seed, "mix", id_col).alias("_u"))
    return sizes.withColumn("_class", _size_class())


def copies_by_class(sizes: DataFrame, weights: Sequence[int], most: int, seed: int) -> tuple[DataFrame, int]:
    """Stored (_source, _class, _m, source_size, target, _whole, _mark), and the number of rows of `sizes`.

    `_m` is the rows of the class; those with a draw up to `_mark` get one copy more than `_whole`.
    """
    rates = _rates(source_targets(sizes, weights, most))
    classes = sizes.groupBy("_source", "_class").agg(F.count("*").alias("_m")).join(rates.drop("_n"), "_source")
    # A source has at most two classes for each bit of its sizes.
    so_far = F.sum("_m").over(Window.partitionBy("_source").orderBy("_class"))
    start = hash_unit(seed, "start", "_source")
    quota = F.floor(so_far * F.col("_part") + start) - F.floor((so_far - F.col("_m")) * F.col("_part") + start)
    classes = written(classes.withColumn("_quota", quota), "mix-classes")
    total = classes.agg(F.coalesce(F.sum("_m"), F.lit(0))).first()[0]
    keys = ["_source", "_class"]
    ranked = numbered(sizes.select(*keys, "_u"), [F.asc("_u")], keys, "_at")
    marks = attach_groups(ranked, classes.select(*keys, "_m", "_quota"), keys, "_m", total).where("_at = _quota")
    return written(classes.join(marks.select(*keys, F.col("_u").alias("_mark")), keys, "left").drop("_quota", "_part"),
                   "mix-marks"), total


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """One row per row of `df`: id, size, source_size, target (both its source's) and taken words."""
    sizes = written(_draws(df, id_col, text_col, source_col, seed, F.col(id_col).alias("_id")), "mix-sizes")
    classes, total = copies_by_class(sizes, weights, most, seed)
    out = attach_groups(sizes, classes, ["_source", "_class"], "_m", total)
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target",
                      (F.col("size") * _copies()).alias("taken"))


def take_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """The rows of `df` as the mix takes them: left out, once, or repeated."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_all")
    sizes = written(_draws(df, id_col, text_col, source_col, seed), "mix-sizes")
    classes, total = copies_by_class(sizes, weights, most, seed)
    wide = _draws(df, id_col, text_col, source_col, seed, whole)
    out = attach_groups(wide, classes, ["_source", "_class"], "_m", total).withColumn("_copies", _copies()).where("_copies > 0")
    return out.select("_all", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select("_all.*")


def _copies() -> Column:
    """A class without a mark gets no extra copies."""
    return F.col("_whole") + F.when(F.col("_u") <= F.col("_mark"), 1).otherwise(0).cast("long")


__all__ = ["BROADCAST_ROWS", "mix", "source_targets", "take_mix", "word_count"]
