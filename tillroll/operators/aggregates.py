"""Keyed aggregations.  Spark sums partially before it shuffles, so a frequent key loads no task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import year_half, year_month
from ..functions.numbers import exact


def products(items: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """item_id, year_month, quantity, subtotal (decimals) of transaction items; here and below by the columns ``also`` as well."""
    return items.groupBy(*also, "item_id", year_month(F.col("created_at")).alias("year_month")).agg(
        F.sum(exact(F.col("quantity"))).alias("quantity"), F.sum(exact(F.col("subtotal"))).alias("subtotal")
    )


def merged_products(sums: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Sums of :func:`products` over parts of the items, added up."""
    return sums.groupBy(*also, "item_id", "year_month").agg(F.sum("quantity").cast("decimal(38,6)").alias("quantity"), F.sum("subtotal").cast("decimal(38,6)").alias("subtotal"))


def purchases(transactions: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """store_id, user_id, purchases long; rows without store or user don't count."""
    return transactions.where(F.col("store_id").isNotNull() & F.col("user_id").isNotNull()).groupBy(*also, "store_id", "user_id").agg(F.count(F.lit(1)).alias("purchases"))


def tpv(transactions: DataFrame, key: str = "store_id", also: tuple[str, ...] = ()) -> DataFrame:
    """store_id (or another key), year_half, tpv (decimal): total payment value."""
    rows = transactions.where(F.col(key).isNotNull())
    return rows.groupBy(*also, year_half(F.col("created_at")).alias("year_half"), key).agg(F.sum(exact(F.col("final_amount"))).alias("tpv"))


def tpv_of_homes(transactions: DataFrame, homes: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """The same where a transaction's store is that of its user (``homes``: user_id, store_id).

    Users' sums meet the stores, not the transactions; users without a store don't count.
    """
    return stores_tpv(tpv(transactions, "user_id", also), homes, also)


def stores_tpv(of_users: DataFrame, homes: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    rows = of_users.join(homes, "user_id").where(F.col("store_id").isNotNull())
    return rows.groupBy(*also, "year_half", "store_id").agg(F.sum("tpv").alias("tpv"))


def purchases_of_users(transactions: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """user_id, purchases long."""
    return transactions.where(F.col("user_id").isNotNull()).groupBy(*also, "user_id").agg(F.count(F.lit(1)).alias("purchases"))


def purchases_of_homes(transactions: DataFrame, homes: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """store_id, user_id, purchases long, where a transaction's store is that of its user."""
    return stores_purchases(purchases_of_users(transactions, also), homes, also)


def stores_purchases(of_users: DataFrame, homes: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    rows = of_users.join(homes, "user_id").where(F.col("store_id").isNotNull())
    return rows.groupBy(*also, "store_id", "user_id").agg(F.sum("purchases").alias("purchases"))
