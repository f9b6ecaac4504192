"""Each row once, however late it comes.

A watermark bounds the state of a stream by dropping what comes after it.  Here
nothing is dropped: the rows that were written are the memory.  They lie in a
folder for each batch and event day, so a batch is compared with what was written
for its own days only (as a rule the present one), by a join that Spark spreads
and splits; no state grows, and a batch that is repeated after a failure replaces
its own folder.  Rows from before ``latest time so far - delay`` are marked as
late, so what has been reported without them can be mended.

A repetition has the key and the event day of the row before it, as a row sent
again has.  Of rows that repeat inside a batch the one with the earliest time
counts, then the one with the smallest hash.  A null time is a day of its own and
never late; a null key is a key.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import free_name
from ..operators.ranking import top_k
from .publish import complete, complete_versions, folder_of, is_complete, note_of, read_versions

#: More days than this in one batch are compared as a range.
MOST_DAYS = 1000


def append_once(stream: DataFrame, key: str, ts: str, delay: timedelta, target: str, checkpoint: str) -> None:
    """Read what there is and add the rows whose ``key`` is new to ``target``, with
    ``late`` boolean; :func:`written` reads them."""

    def write(batch: DataFrame, number: int) -> None:
        add_once(batch, key, ts, delay, target, number)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def add_once(batch: DataFrame, key: str, ts: str, delay: timedelta, target: str, number: int) -> None:
    """One batch of :func:`append_once`; earlier ones have smaller numbers."""
    spark = batch.sparkSession
    if is_complete(spark, target, number):
        return
    before = [v for v in complete_versions(spark, target) if v < number]
    horizon = note_of(spark, target, before[-1]) if before else ""
    day, tie = free_name("day", batch), free_name("_tie", batch)
    rows = batch.withColumn(day, F.col(ts).cast("date")).withColumn(tie, F.xxhash64(*batch.columns))
    first = top_k(rows, [key, day], [F.col(ts).asc(), F.col(tie).asc()], 1).drop(tie)
    if before:
        first = first.join(_keys(rows, read_versions(spark, target, before), key, day), _same(first, key, day), "left_anti")
    late = F.col(ts) < F.lit(datetime.fromisoformat(horizon) - delay).cast("timestamp_ntz") if horizon else F.lit(False)
    first.withColumn("late", F.coalesce(late, F.lit(False))).write.mode("overwrite").partitionBy(day).parquet(folder_of(target, number))
    latest = batch.agg(F.max(ts).alias("t")).first()["t"]
    seen = [t for t in (latest, datetime.fromisoformat(horizon) if horizon else None) if t is not None]
    complete(spark, target, number, max(seen).isoformat() if seen else "")


def _keys(rows: DataFrame, written_: DataFrame, key: str, day: str) -> DataFrame:
    """Keys that were written for the days of ``rows``."""
    days = [r[day] for r in rows.select(day).distinct().limit(MOST_DAYS + 1).collect()]
    known = [d for d in days if d is not None]
    near = F.col(day).isin(known)
    if len(days) > MOST_DAYS:
        ends = rows.agg(F.min(day).alias("low"), F.max(day).alias("high")).first()
        near = F.col(day).between(ends["low"], ends["high"])
    return written_.where(near | F.col(day).isNull()).select(F.col(key).alias("_key"), F.col(day).alias("_day"))


def _same(rows: DataFrame, key: str, day: str):
    return rows[key].eqNullSafe(F.col("_key")) & rows[day].eqNullSafe(F.col("_day"))


def written(spark: SparkSession, target: str) -> DataFrame:
    """All rows that complete batches wrote, with ``late``."""
    return read_versions(spark, target, complete_versions(spark, target))
