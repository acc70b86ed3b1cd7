"""Joins of many rows with few whose key may be one value for a third of all rows: the few are repeated under SALTS salts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32


def salt(*columns: str | Column) -> Column:
    """The salt of a row of the large side, from columns that tell its rows apart."""
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS))


def salted(small: DataFrame) -> DataFrame:
    """The small side, once under every salt."""
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
