"""Rendezvous hashing of record keys over weighted shards.

Every shard scores a key by a hash of both, shaped by its weight, and the highest score
takes the record. A shard's score for a key doesn't depend on the other shards, so a new
shard takes records only into itself and a lost one gives its own away to all others.
The record's place follows from its key and the shards alone: no state, no shuffle.

Null keys go where the key "null" goes; equal keys share a shard. Null texts have size 1.
An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offertide.functions.ranked import numbered
from offertide.llm.common import text_or_empty

SHARDS = 8


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of the highest score -weight / log(u), ties to the smallest shard."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    scores = []
    for shard, weight in sorted(weights.items()):
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(f"shard {shard}"), text), 12).cast("double")
        u = (bits + F.lit(0.5)) / F.lit(float(1 << 52))
        scores.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("minus")))
    return -F.array_max(F.array(*scores))["minus"]


def shard_report(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df` with its shard, its place there and its shard after adding one."""
    raw = F.encode(text_or_empty(text_col), "UTF-8")
    placed = df.select(
        F.col(id_col).alias("_id"), (F.octet_length(text_or_empty(text_col)).cast("long") + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"),
        rendezvous(F.col(id_col), dict.fromkeys(range(shards), 1.0)).alias("shard"),
        rendezvous(F.col(id_col), dict.fromkeys(range(shards + 1), 1.0)).alias("grown_shard"))
    ranked = numbered(placed, [F.col("_id"), F.col("size"), F.col("text_crc32")], ["shard"], name="_rank")
    return ranked.select(F.col("_id").alias(id_col), "size", "text_crc32", "law", "shard",
                         (F.col("_rank") - 1).alias("slot"), "grown_shard")


def write_shards(df: DataFrame, path: str, weights: Mapping[int, float], key: str = "doc_id",
                 files_per_shard: int = 8) -> None:
    """Write `df` under one folder per shard, each in `files_per_shard` files."""
    df = df.withColumn("_shard", rendezvous(F.col(key), weights))
    piece = F.pmod(F.xxhash64(F.col(key)), F.lit(files_per_shard))
    df.repartition(len(weights) * files_per_shard, "_shard", piece).write.mode("overwrite").partitionBy("_shard").parquet(path)
