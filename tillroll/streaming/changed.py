"""Keyed sums of a stream, of which each batch writes what has changed.

Update mode hands on the keys that a batch touched, with their sums so far.  A batch
writes these rows as a version of its own (:mod:`publish`); the present sums of a key
are those of the newest version that has it.  So a batch costs what it touches, not
what the stream has seen; when ``COMPACT`` versions have come together, one holds the
present rows of all.  What is made of the sums (names, rankings) is made by readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import remove
from .publish import BASE, COMPACT, FOLDER, complete, folder_of, is_complete, live_versions


def run_changes(sums: DataFrame, keys: list[str], target: str, checkpoint: str) -> None:
    """Read what there is, with state and progress in ``checkpoint``, and add the changed rows to ``target``."""

    def write(batch: DataFrame, number: int) -> None:
        add_changes(batch, keys, target, number)

    sums.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def add_changes(batch: DataFrame, keys: list[str], target: str, number: int) -> None:
    """One batch of :func:`run_changes`; a batch that failed is written anew, a finished one stays."""
    spark = batch.sparkSession
    if is_complete(spark, target, number):
        return
    rows, note, live = batch, "", live_versions(spark, target)
    if len(live) >= COMPACT:
        # A batch is computed once: its rows are written before they are merged.
        fresh = f"{target}/changed-{number}"
        batch.write.mode("overwrite").parquet(fresh)
        rows = _newest(_versions(spark, target, live).unionByName(spark.read.parquet(fresh).withColumn(FOLDER, F.lit(number))), keys)
        note = BASE
    rows.write.mode("overwrite").parquet(folder_of(target, number))
    complete(spark, target, number, note)
    if note:
        remove(spark, fresh)


def _versions(spark: SparkSession, target: str, versions: list[int]) -> DataFrame:
    return spark.read.option("basePath", target).parquet(*(folder_of(target, v) for v in versions))


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row of its newest version; aggregated before the exchange."""
    values = [c for c in rows.columns if c not in (*keys, FOLDER)]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), FOLDER).alias("_newest"))
    return newest.select(*keys, *(F.col(f"_newest.{c}").alias(c) for c in values))


def current(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The present sums of all keys."""
    return _newest(_versions(spark, target, live_versions(spark, target)), keys)
