"""Small numeric expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def flag(condition: Column) -> Column:
    """1 if true, else 0 (null counts as 0)."""
    return F.when(condition, 1).otherwise(0)


OFF_HALF = 1.7e-10
"""Moves exact halves off the rounding boundary, where summation order would decide."""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column, so that two engines can be compared."""
    return df.select(*[
        F.round(F.col(f.name) + F.lit(OFF_HALF), digits).alias(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])
