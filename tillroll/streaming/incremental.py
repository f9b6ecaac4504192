"""Sums over files that keep coming: a run reads the files that are new.

A store is a row of runs (:mod:`publish`).  A run lists the files, leaves out those
that the runs before it have read, sums up the rest, and keeps two things: the
partial sums, which can be merged, and its files.  Totals are the merged partial
sums of all runs.  A run that fails is written anew; one without new files adds
nothing.  When ``COMPACT`` runs have come together, one merges them into a base.

Rows are dealt evenly before they are summed, so a task's table of sums follows the
size of a shuffle's partitions, not that of the files that come or of their row groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .publish import BASE, COMPACT, complete, complete_versions, folder_of, live_versions


def identity() -> Column:
    """What tells files apart: name and size, so a file that is offered again from another folder is known."""
    return F.concat_ws("|", F.element_at(F.split("path", "/"), -1), F.col("length").cast("string"))


def listed(spark: SparkSession, folders: list[str], pattern: str) -> DataFrame:
    """path, name: the files below the folders; their contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folders)
    return found.select("path", identity().alias("name"))


def new_files(spark: SparkSession, store: str, folders: list[str], pattern: str = "*.parquet") -> list[str]:
    """Paths that no run has read, one for each name.  The list is what the scan's own planning holds on the driver."""
    files = listed(spark, folders, pattern).groupBy("name").agg(F.min("path").alias("path"))
    runs = complete_versions(spark, store)
    if runs:
        known = spark.read.parquet(*(f"{folder_of(store, v)}/files" for v in runs))
        files = files.join(known.select("name").distinct(), "name", "left_anti")
    return sorted(r["path"] for r in files.collect())


def even(rows: DataFrame) -> DataFrame:
    """The same rows in partitions of Spark's advisory size; all columns decide, so a frequent key is in many."""
    return rows.hint("rebalance", *rows.columns)


def update(spark: SparkSession, store: str, folders: list[str], read: Callable[[list[str]], DataFrame], partial: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], pattern: str = "*.parquet") -> list[str]:
    """Add what is new, and say which files that was.

    ``partial`` gives the sums of rows, ``merge`` adds up rows of such sums (with the same columns).
    """
    paths = new_files(spark, store, folders, pattern)
    if not paths:
        return []
    runs, live = complete_versions(spark, store), live_versions(spark, store)
    number = runs[-1] + 1 if runs else 0
    sums, note = partial(even(read(paths))), ""
    if len(live) >= COMPACT:
        sums, note = merge(even(sums.unionByName(_sums(spark, store, live)))), BASE
    sums.write.mode("overwrite").parquet(f"{folder_of(store, number)}/sums")
    listed(spark, paths, pattern).write.mode("overwrite").parquet(f"{folder_of(store, number)}/files")
    complete(spark, store, number, note)
    return paths


def _sums(spark: SparkSession, store: str, runs: list[int]) -> DataFrame:
    return spark.read.parquet(*(f"{folder_of(store, v)}/sums" for v in runs))


def totals(spark: SparkSession, store: str, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The sums over all files that were read so far."""
    return merge(even(_sums(spark, store, live_versions(spark, store))))
