"""The retail tables as found among the tables of a test folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import read_parquet_table
from .params import Params

#: Years with data in the orders star, and in the events.
ORDER_YEARS = Params(year_start=1997, year_end=1998)
EVENT_YEARS = Params()


class Tables:
    """Each property is a lazy DataFrame with the columns that queries need."""

    def __init__(self, spark: SparkSession, folder: str):
        self._read = lambda name: read_parquet_table(spark, folder, name)

    @property
    def homes(self) -> DataFrame:
        """The store of each user; the facts have none."""
        return self._read("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("bigint").alias("store_id"))

    def _stores_of(self, facts: DataFrame) -> DataFrame:
        """Every row with the store of its user, for queries that return rows."""
        return facts.join(self.homes, "user_id").select("transaction_id", "store_id", "user_id", "final_amount", "created_at")

    @property
    def orders(self) -> DataFrame:
        o = self._read("orders")
        return o.select(F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("final_amount"), F.col("o_orderdate").alias("created_at"))

    @property
    def events(self) -> DataFrame:
        e = self._read("events")
        return e.select(F.col("event_id").alias("transaction_id"), "user_id", F.col("value").alias("final_amount"), F.col("ts").alias("created_at"))

    @property
    def store_orders(self) -> DataFrame:
        return self._stores_of(self.orders)

    @property
    def store_events(self) -> DataFrame:
        return self._stores_of(self.events)

    @property
    def items(self) -> DataFrame:
        l = self._read("lineitem")  # noqa: E741
        return l.select(
            F.col("l_orderkey").alias("transaction_id"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("subtotal"), F.col("l_shipdate").alias("created_at")
        )

    @property
    def menu(self) -> DataFrame:
        return self._read("part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("item_name"))

    @property
    def stores(self) -> DataFrame:
        return self._read("nation").select(F.col("n_nationkey").cast("bigint").alias("store_id"), F.col("n_name").alias("store_name"))

    @property
    def users(self) -> DataFrame:
        """Names take the place of birthdates, which no table has."""
        return self._read("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"))
