"""The best of each group, with stated ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import free_name


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark also limits the groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    name = free_name("_rank", df)
    return df.withColumn(name, rank).where(F.col(name) <= k).drop(name)


def argmax(df: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """The row with the largest value of each group; of equals the one with the smallest ``tie``."""
    return top_k(df, by, [F.col(value).desc(), F.col(tie).asc()], 1)


def top3_users(purchases: DataFrame) -> DataFrame:
    """Three users of each store: most purchases first, of equals the larger user_id."""
    return top_k(purchases, ["store_id"], [F.col("purchases").desc(), F.col("user_id").desc()], 3)
