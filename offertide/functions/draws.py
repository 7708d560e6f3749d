"""Random draws that depend only on a seed and a row key, never on the partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the 32-bit FNV-1a hash.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
WORD = 4294967295

_HEX_DIGITS = 13
_SPAN = float(16**_HEX_DIGITS)


def keyed_uniform(seed: int, purpose: str, *keys) -> Column:
    """Uniform in (0, 1) from the first 52 bits of md5(seed|purpose|key|...)."""
    text = F.concat_ws("|", F.lit(f"{seed}|{purpose}"), *[_column(k).cast("string") for k in keys])
    bits = F.conv(F.substring(F.md5(text), 1, _HEX_DIGITS), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(_SPAN)


def gumbel(u: Column) -> Column:
    return -F.log(-F.log(u))


def poisson_one(u: Column) -> Column:
    """Poisson(1) count by inversion of the distribution function."""
    total, term, steps = 0.0, math.exp(-1.0), []
    for k in range(18):
        total += term
        steps.append(total)
        term /= k + 1
    # A chain of comparisons is compiled and ends at the first step above u; a lambda over an array of the steps is neither.
    count = F.when(u < F.lit(steps[0]), 0)
    for k, step in enumerate(steps[1:], 1):
        count = count.when(u < F.lit(step), k)
    return count.when(u.isNotNull(), len(steps)).otherwise(0)


def fnv_uniform(seed: int, text: Column) -> Column:
    """32-bit FNV-1a of an ASCII text, seed xor-ed into the offset, scaled to [0, 1)."""
    codes = F.transform(
        F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substr(text, i, F.lit(1))).cast("long")
    )
    start = F.lit((FNV_OFFSET ^ seed) & WORD).cast("long")
    mixed = F.aggregate(
        codes, start, lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(WORD))
    )
    return F.when(F.length(text) > 0, mixed).otherwise(start) / F.lit(float(WORD + 1))


def _column(key) -> Column:
    return F.col(key) if isinstance(key, str) else key
