"""Preference pairs: the turns that both conversations begin with become the prompt.

Input is one row per turn. A pair joins conversation 2k (chosen) with 2k + 1 (rejected),
or any pairing given as columns. Turns are ordered by turn number; a repeated number is
ordered by role and text. The longest common prefix of (role, text) is rendered once; what
follows in either conversation is its completion. Masks list the half-open ranges of code
points, in the completion, that belong to assistant texts: only those are learnt.

Rows without conversation id belong to no conversation. A null role is written "unknown",
a null text is empty; nulls equal nulls. If one conversation is missing its completion is
null and the prompt is empty. Marks in texts are broken by a space, so that no text can
open or close a turn. Everything is one partial-free aggregation by pair: a pair's rendered
text is one value, so its turns must meet in one task; pairs don't meet each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The turn template.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def _turn(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))


def _mask(turns: Column) -> Column:
    """'start:end' of each assistant text, comma-joined."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(acc, t):
        first = acc["at"] + F.length(t["role"]) + F.lit(len(OPEN) + len(CLOSE))
        last = first + F.length(t["text"])
        span = F.concat_ws(":", first.cast("string"), last.cast("string"))
        return F.struct(
            (last + F.lit(len(END))).cast("long").alias("at"),
            F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, add, lambda acc: F.array_join(acc["spans"], ","))


def preference_pairs(turns: DataFrame, pair: Column | None = None, rejected: Column | None = None) -> DataFrame:
    """One row per pair: pair_id, common_turns, prompt, completions and their masks."""
    pair = F.floor(F.col("conv_id") / 2).cast("long") if pair is None else pair
    rejected = (F.pmod(F.col("conv_id"), F.lit(2)) == 1) if rejected is None else rejected
    clean = lambda c, other: F.replace(F.coalesce(F.col(c), F.lit(other)), F.lit(OPEN), F.lit("< |"))
    row = F.struct(F.col("turn").alias("turn"), clean("role", "unknown").alias("role"), clean("text", "").alias("text"))
    both = turns.where(pair.isNotNull() & rejected.isNotNull()).groupBy(pair.alias("pair_id")).agg(
        F.array_sort(F.collect_list(F.when(~rejected, row))).alias("c"),
        F.array_sort(F.collect_list(F.when(rejected, row))).alias("r"))
    shorter = F.least(F.size("c"), F.size("r"))
    differ = F.filter(F.sequence(F.lit(0), F.greatest(shorter - 1, F.lit(0))), lambda i: (
        (F.get("c", i)["role"] != F.get("r", i)["role"]) | (F.get("c", i)["text"] != F.get("r", i)["text"])))
    common = F.when(shorter == 0, 0).otherwise(F.coalesce(F.get(differ, F.lit(0)), shorter))
    cut = both.withColumn("n", common).select(
        "pair_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"),
        *[F.slice(s, F.col("n") + 1, F.greatest(F.size(s), F.lit(1))).alias(s) for s in ("c", "r")],
        *[(F.size(s) > 0).alias(f"has_{s}") for s in ("c", "r")])
    return cut.select(
        "pair_id", F.col("n").cast("long").alias("common_turns"), _rendered(F.col("p")).alias("prompt"),
        *[F.when(F.col(f"has_{s}"), f(F.col(s))).alias(f"{name}_{what}")
          for s, name in (("c", "chosen"), ("r", "rejected"))
          for what, f in (("completion", _rendered), ("mask", _mask))])
