"""Left joins with a dimension, and what stands for a missing entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import free_name


def lookup(fact: DataFrame, dim: DataFrame, key: str, value: str, missing: Column | None = None, null: Column | None = None, unique: bool = False, newest: str | None = None) -> DataFrame:
    """``fact`` with the column ``value`` of ``dim``.

    ``missing`` stands for an absent key, ``null`` for an entry without a value.
    Of entries with the same key the largest value counts, or the one with the
    largest ``newest`` if that column is named (``unique``: there are no such
    entries, and nothing has to be grouped).  No side is forced to be
    broadcast: Spark does so below its size threshold, and merges otherwise.
    """
    there = dim.where(F.col(key).isNotNull())
    if not unique:
        best = F.max_by(value, F.struct(newest, value)) if newest else F.max(value)
        there = there.groupBy(key).agg(best.alias(value))
    name = free_name("_there", fact, dim)
    there = there.select(key, value, F.lit(True).alias(name))
    found = F.when(F.col(name).isNull(), missing if missing is not None else F.lit(None)).otherwise(F.coalesce(F.col(value), null if null is not None else F.lit(None)))
    return fact.join(there, key, "left").withColumn(value, found).drop(name)


#: The texts UNKNOWN and NO_JOINER_DATA_ that the reports show for absent entries.


def item_names(fact: DataFrame, menu: DataFrame, unique: bool = False) -> DataFrame:
    return lookup(fact, menu, "item_id", "item_name", F.lit("UNKNOWN"), F.lit(""), unique)


def store_names(fact: DataFrame, stores: DataFrame, unique: bool = False) -> DataFrame:
    return lookup(fact, stores, "store_id", "store_name", F.lit("UNKNOWN"), F.lit("UNKNOWN"), unique)


def store_names_or_id(fact: DataFrame, stores: DataFrame, unique: bool = False) -> DataFrame:
    other = F.concat(F.lit("NO_JOINER_DATA_"), F.col("store_id").cast("string"))
    return lookup(fact, stores, "store_id", "store_name", other, other, unique)


def birthdates(fact: DataFrame, users: DataFrame, value: str = "birthdate", unique: bool = False) -> DataFrame:
    return lookup(fact, users, "user_id", value, unique=unique)
