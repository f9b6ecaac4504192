"""Several clients' files beside each other, each with results of its own.

A client is a folder, ``client=<name>``; the name is a key of every aggregation,
so one run serves all clients, or those that are asked for.  Results lie in a folder
for each client; a run replaces the folders of its own clients only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import remove
from . import retail
from .params import Params

CLIENT = "client"


def read_clients(spark: SparkSession, folder: str, clients: list[str] | None = None) -> DataFrame:
    """Parquet files of all clients, or of some, with the column ``client``; other clients' files aren't listed."""
    paths = [f"{folder}/{CLIENT}={c}" for c in clients] if clients else [folder]
    return spark.read.option("basePath", folder).parquet(*paths).withColumn(CLIENT, F.col(CLIENT).cast("string"))


def tpv_of_clients(transactions: DataFrame, stores: DataFrame, p: Params, homes: DataFrame | None = None, unique: bool = False) -> DataFrame:
    """client, year_half_created_at, store_name, tpv: the third question for each client."""
    return retail.q3(transactions, stores, p, unique=unique, homes=homes, also=(CLIENT,))


def replace_results(df: DataFrame, target: str) -> None:
    """Write each client's rows to its folder; what it held goes, other clients' folders stay as they are."""
    # Rows of a client come together, so that it has few files.
    df.repartition(CLIENT).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(CLIENT).parquet(target)


def cancel(spark: SparkSession, target: str, client: str) -> None:
    """Remove one client's results."""
    remove(spark, f"{target}/{CLIENT}={client}")
