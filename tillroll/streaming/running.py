"""Aggregations over streams of files: complete sums, ranked when a batch ends.

The operators are those of the batch queries.  A ranking isn't allowed on a
stream, so each micro-batch's complete sums are handed to ``finish`` (a function
of a DataFrame) in ``foreachBatch``, and its result takes the last one's place
(:mod:`publish`): while a batch is written, and if it fails, the last one is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .publish import publish


def run_available(sums: DataFrame, finish: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Read what there is, with state and progress in ``checkpoint``, and publish the
    finished result in ``target``.  A later call goes on with new files only."""

    def write(batch: DataFrame, number: int) -> None:
        publish(finish(batch), target, number)

    query = sums.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_available(rows: DataFrame, target: str, checkpoint: str) -> list[dict]:
    """Read what there is and append the rows to ``target``, each batch exactly once; the batches' progress."""
    query = rows.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return list(query.recentProgress)
