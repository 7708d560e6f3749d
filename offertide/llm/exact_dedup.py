"""Exact duplicates with a two-pass Bloom filter.

Pass one marks, for the hash of every normalised text, two slots of a filter and keeps
the slots that were marked more than once. Pass two checks every row: unless both its
slots were marked again, no other row can have its text, and it passes straight through.
Only the other rows shuffle. The filter never decides that two texts are equal; it only
spares rows the shuffle, so its size changes the work and not the result.

Null and empty texts count as the same empty text. Of equal texts the row with the smallest id
stays, null ids last; if a row is repeated with its id, one of the copies stays. An
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offertide.llm.common import SPACES, attach_groups, text_or_empty, written

SLOTS_PER_ROW = 16
MOST_SLOTS = 1 << 26
"""Largest filter (8 MB of bits). Beyond 4 million rows it fills up and more rows shuffle."""

_SHA, _HASH = "_sha", "_hash"


def normalised(column: str) -> Column:
    return F.regexp_replace(text_or_empty(column), SPACES, " ")


def text_sha256(column: str) -> Column:
    return F.sha2(F.encode(normalised(column), "UTF-8"), 256)


def _filter(hashes: DataFrame, rows: int, least: int) -> tuple[DataFrame, int]:
    """(word, bits): the slots marked at least `least` times, 64 to a word, and the number of slots.

    At most MOST_SLOTS / 64 words, whatever the number of rows.
    """
    slots = 1 << 10
    while slots < min(rows * SLOTS_PER_ROW, MOST_SLOTS):
        slots *= 2
    marks = hashes.select(F.explode(F.array(_slot(0, slots), _slot(1, slots))).alias("slot"))
    marks = marks.groupBy("slot").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    words = marks.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    return written(words, "bloom-filter"), slots


def repeated_slots(hashes: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """The filter of hashes that may be repeated among `hashes(_hash)`."""
    return _filter(hashes, rows, 2)


def known_slots(hashes: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """The filter of the hashes in `hashes(_hash)`."""
    return _filter(hashes, rows, 1)


def _slot(which: int, slots: int) -> Column:
    part = F.col(_HASH) if which == 0 else F.shiftrightunsigned(F.col(_HASH), 32)
    return part.bitwiseAND(F.lit(slots - 1))


def marked(rows: DataFrame, words: DataFrame, slots: int) -> DataFrame:
    """`rows` with `_suspect`: false proves that the filter was made without the row's hash (or its repetition)."""
    for which in (0, 1):
        side = F.broadcast(words.select(F.col("word").alias(f"_w{which}"), F.col("bits").alias(f"_b{which}")))
        rows = rows.withColumn(f"_w{which}", F.shiftright(_slot(which, slots), 6)).join(side, f"_w{which}", "left")
    hit = [F.expr(f"(shiftright(coalesce(_b{i}, 0L), cast({low} & 63 as int)) & 1L) = 1L")
           for i, low in ((0, _HASH), (1, f"shiftrightunsigned({_HASH}, 32)"))]
    return rows.withColumn("_suspect", hit[0] & hit[1]).drop("_w0", "_w1", "_b0", "_b1")


def duplicate_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: the id, keep_id, group_size, kept and text_sha256."""
    keyed = written(
        df.select(F.col(id_col).alias("_id"), text_sha256(text_col).alias(_SHA),
                  F.monotonically_increasing_id().alias("_row")), "dedup-keys"
    ).withColumn(_HASH, F.xxhash64(_SHA))
    total = keyed.count()
    words, slots = repeated_slots(keyed.select(_HASH), total)
    checked = written(marked(keyed, words, slots), "dedup-marked")
    suspects = checked.where("_suspect").select("_id", _SHA, "_row")
    first = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    groups = written(
        suspects.groupBy(_SHA).agg(F.count("*").alias("_n"), F.min(first).alias("_first")).where("_n > 1"),
        "dedup-groups")
    judged = attach_groups(suspects, groups, [_SHA], "_n", total)
    alone = F.col("_n").isNull()
    repeated = judged.select(
        F.col("_id").alias(id_col), F.when(alone, F.col("_id")).otherwise(F.col("_first.id")).alias("keep_id"),
        F.coalesce("_n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("_row") == F.col("_first.row"))).alias("kept"), F.col(_SHA).alias("text_sha256"))
    straight = checked.where("NOT _suspect").select(
        F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col(_SHA).alias("text_sha256"))
    return straight.unionByName(repeated)


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` that stay, whole and with their own columns.

    Rows that cannot be repeated keep their place. The others shuffle; copies are merged
    in each task before that, so a text that fills a third of the table is no hot key.
    """
    hashes = df.select(text_sha256(text_col).alias(_SHA)).select(F.xxhash64(_SHA).alias(_HASH))
    hashes = written(hashes, "dedup-hashes")
    words, slots = repeated_slots(hashes, hashes.count())
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_all"),
                       F.col(id_col).alias("_id"), text_sha256(text_col).alias(_SHA))
    checked = marked(packed.withColumn(_HASH, F.xxhash64(_SHA)), words, slots)
    rank = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"))
    first = checked.where("_suspect").groupBy(_SHA).agg(F.min_by("_all", rank).alias("_all"))
    return checked.where("NOT _suspect").select("_all").unionByName(first.select("_all")).select("_all.*")
