"""Sums of calendar months, each given once, when its month is over.

Spark closes windows of fixed length only.  Months get one: a time becomes a place
on an axis on which every month has 31 days, and the windows of that axis are the
months.  A month closes when a row ``delay`` into a later month (at most 28 days)
has been seen; the engine then drops its state.  Rows that come later than that
find their month closed; the engine counts them, and :func:`..late.append_once`
with the same delay marks them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import year_month
from ..operators import free_name

_DAY = 86_400_000_000
_MONTH = 31 * _DAY


def month_axis(ts: Column) -> Column:
    """The place of a time on the axis, as a timestamp."""
    months = (F.year(ts) - 1970) * 12 + F.month(ts) - 1
    seconds = F.extract(F.lit("SECOND"), ts) * 1_000_000  # with its parts
    inside = (F.day(ts) - 1).cast("bigint") * F.lit(_DAY) + (F.hour(ts) * 60 + F.minute(ts)).cast("bigint") * F.lit(60_000_000) + seconds.cast("bigint")
    return F.timestamp_micros(months.cast("bigint") * F.lit(_MONTH) + inside)


def month_of(axis: Column) -> Column:
    """The month of a place on the axis, as its first instant."""
    months = F.floor(F.unix_micros(axis) / F.lit(_MONTH))
    return F.make_timestamp_ntz((1970 + F.floor(months / 12)).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def closed_months(stream: DataFrame, ts: str, delay: str, by: list[str], sums: list[Column]) -> DataFrame:
    """year_month, the columns ``by`` and ``sums`` of each month that is over; rows without a time have no month."""
    at = free_name("_at", stream)
    timed = stream.where(F.col(ts).isNotNull()).withColumn(at, month_axis(F.col(ts))).withWatermark(at, delay)
    totals = timed.groupBy(F.window(at, "31 days").alias("_window"), *by).agg(*sums)
    return totals.withColumn("year_month", year_month(month_of(F.col("_window.start")))).drop("_window")


def dropped_rows(progress: list[dict]) -> int:
    """Groups that came after their month had closed, by batch partition, from the batches' progress."""
    return sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])
