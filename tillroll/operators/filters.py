"""Range filters.  A null never passes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_year(df: DataFrame, ts: str, first: int, last: int) -> DataFrame:
    """Years ``first`` to ``last``, both included, as a half-open range of time, which reaches the scan."""
    low, high = (F.lit(datetime(y, 1, 1)).cast("timestamp_ntz") for y in (first, last + 1))
    return df.where((F.col(ts) >= low) & (F.col(ts) < high))


def by_hour(df: DataFrame, ts: str, first: int, last: int) -> DataFrame:
    """Hour numbers ``first`` to ``last``, both included: 23:59:59 has hour 23."""
    return df.where(F.hour(ts).between(first, last))


def by_amount(df: DataFrame, amount: str, least: float) -> DataFrame:
    return df.where(F.col(amount) >= F.lit(float(least)))


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df
