"""Facts and a dimension that comes later.

Both are streams.  A fact waits for its entry as long as ``wait`` says, on the time
axis of both; then it is given without one.  So the state is bounded: facts go when
the slower stream has passed their time and ``wait``, entries likewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_later(facts: DataFrame, entries: DataFrame, key: str, value: str, at: str, wait: str, missing: Column, null: Column) -> DataFrame:
    """``facts`` with the column ``value`` of the entry with the same ``key`` whose time ``at`` is
    at most ``wait`` after the fact's and not before it.

    ``missing`` stands for an entry that hasn't come, ``null`` for one without a value.
    A fact without a key is left out, as it would have to be matched with all or none.
    Facts are told apart by nothing: equal ones are given as often as they came.
    """
    there = entries.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(value).alias("_value"), F.col(at).alias("_at"), F.lit(True).alias("_there"))
    left = facts.where(F.col(key).isNotNull()).withWatermark(at, "0 seconds")
    right = there.withWatermark("_at", "0 seconds")
    near = F.expr(f"_key = `{key}` and _at >= `{at}` and _at <= `{at}` + interval {wait}")
    joined = left.join(right, near, "leftOuter")
    found = F.when(F.col("_there").isNull(), missing).otherwise(F.coalesce("_value", null))
    return joined.withColumn(value, found).select(*facts.columns, value)
