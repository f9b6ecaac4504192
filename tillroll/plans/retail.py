"""The four questions, over tables with the columns of ``sources.schemas.NEEDED``.

Facts shrink before they meet a dimension: filter, aggregate, rank, then look up.
Fixed values: the names of the results' columns, which the report files show.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import custom_round
from ..operators import aggregates, filters, lookups, ranking
from .params import Params


def in_years(df: DataFrame, p: Params) -> DataFrame:
    return filters.by_year(df, "created_at", p.year_start, p.year_end)


def in_hours(df: DataFrame, p: Params) -> DataFrame:
    return filters.by_hour(df, "created_at", p.hour_start, p.hour_end)


def q1(transactions: DataFrame, p: Params, also: tuple[str, ...] = ()) -> DataFrame:
    """Transactions of the years and hours with at least the least amount."""
    rows = filters.by_amount(in_hours(in_years(transactions, p), p), "final_amount", p.min_amount)
    return rows.select(*also, "transaction_id", "final_amount")


def q2_1(items: DataFrame, menu: DataFrame, p: Params, unique: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """Of each month the product sold most often."""
    best = ranking.argmax(aggregates.products(in_years(items, p), also), [*also, "year_month"], "quantity", "item_id")
    return lookups.item_names(best, menu, unique).select(*also, F.col("year_month").alias("year_month_created_at"), "item_name", F.col("quantity").cast("bigint").alias("sellings_qty"))


def q2_2(items: DataFrame, menu: DataFrame, p: Params, unique: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """Of each month the product with the highest total."""
    best = ranking.argmax(aggregates.products(in_years(items, p), also), [*also, "year_month"], "subtotal", "item_id")
    return lookups.item_names(best, menu, unique).select(*also, F.col("year_month").alias("year_month_created_at"), "item_name", F.col("subtotal").cast("double").alias("profit_sum"))


def q3(
    transactions: DataFrame, stores: DataFrame, p: Params, hours: bool = True, rounded: bool = False, unique: bool = False, homes: DataFrame | None = None, also: tuple[str, ...] = ()
) -> DataFrame:
    """Total payment value of each half-year and store.  ``homes``: the stores of users, for transactions without a store."""
    rows = in_years(transactions, p)
    rows = in_hours(rows, p) if hours else rows
    sums = aggregates.tpv(rows, also=also) if homes is None else aggregates.tpv_of_homes(rows, homes, also)
    value = F.col("tpv").cast("double")
    return lookups.store_names(sums, stores, unique).select(*also, F.col("year_half").alias("year_half_created_at"), "store_name", (custom_round(value) if rounded else value).alias("tpv"))


def q4(
    transactions: DataFrame, stores: DataFrame, users: DataFrame, p: Params, value: str = "birthdate", unique: bool = False, homes: DataFrame | None = None, also: tuple[str, ...] = ()
) -> DataFrame:
    """Of each store the users with most transactions.  ``homes``: as in :func:`q3`."""
    rows = in_years(transactions, p)
    counts = aggregates.purchases(rows, also) if homes is None else aggregates.purchases_of_homes(rows, homes, also)
    best = ranking.top_k(counts, [*also, "store_id"], [F.col("purchases").desc(), F.col("user_id").desc()], p.top)
    named = lookups.birthdates(lookups.store_names_or_id(best, stores, unique), users, value, unique)
    return named.select(*also, "store_name", value)
