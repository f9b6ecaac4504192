"""Distinct rows and the comparison of two results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import top_k


def distinct_first(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row for each key, the first in ``order``."""
    return top_k(df, [key], order, 1)


def compare(base: DataFrame, result: DataFrame) -> DataFrame:
    """Rows that one of two results lacks, with ``side``: ``missing`` or ``extra``.

    Both are taken as sets, without order or repetition.
    """
    missing = base.subtract(result).withColumn("side", F.lit("missing"))
    return missing.unionByName(result.select(*base.columns).subtract(base).withColumn("side", F.lit("extra")))
