"""All five results from one read of each fact table.

The questions share filters and sums.  Of the transactions one aggregation keeps,
for each user and half-year, the payment value and the number of purchases, and for
each transaction that qualifies its amount; rows of both kinds carry a tag and share
the exchange (partial sums come first).  What it yields is written once, by tag, and
the results are made from that.  Of the items one aggregation has both measures, and
the best of both are found in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import year_half
from ..functions.numbers import exact
from ..operators import aggregates, lookups, ranking
from . import retail
from .params import Params

#: Columns of the results together: the query, and its columns as texts (null where it has fewer).
RESULT = "query string, first string, second string, third string"


def tagged_sums(transactions: DataFrame, p: Params) -> DataFrame:
    """tag, transaction_id, user_id, year_half, amount, purchases, from one scan and one exchange.

    Tag ``kept``: the transactions of the first question, each once; ``user``: of each
    user and half-year the payment value in the hours, and all purchases.
    """
    rows = retail.in_years(transactions, p)
    in_hours = F.coalesce(F.hour("created_at").between(p.hour_start, p.hour_end), F.lit(False))
    amount = exact(F.col("final_amount"))
    none = lambda kind: F.lit(None).cast(kind)
    id_type, user_type = rows.schema["transaction_id"].dataType, rows.schema["user_id"].dataType
    of = lambda tag, key, user, half, value, in_time, count: F.struct(
        F.lit(tag).alias("tag"), key.alias("transaction_id"), user.alias("user_id"), half.alias("year_half"), value.alias("amount"), in_time.alias("in_hours"), count.alias("purchases")
    )
    qualifies = in_hours & (F.col("final_amount") >= p.min_amount)
    kept = of("kept", F.col("transaction_id"), none(user_type), none("string"), F.col("final_amount"), F.lit(True), F.lit(0))
    user = of("user", none(id_type), F.col("user_id"), year_half(F.col("created_at")), F.col("final_amount"), in_hours, F.lit(1))
    both = F.filter(F.array(F.when(qualifies, kept), F.when(F.col("user_id").isNotNull(), user)), lambda x: x.isNotNull())
    tagged = rows.select(F.explode(both).alias("x")).select("x.*").withColumn("exact", exact(F.col("amount")))
    return tagged.groupBy("tag", "transaction_id", "user_id", "year_half").agg(
        F.min("amount").alias("amount"), F.sum(F.when(F.col("in_hours"), F.col("exact"))).alias("tpv"), F.max("in_hours").alias("in_hours"), F.sum("purchases").alias("purchases")
    )


def best_products(items: DataFrame, p: Params) -> DataFrame:
    """year_month, by_quantity, by_subtotal (structs with item_id and the measure), from one scan."""
    sums = aggregates.products(retail.in_years(items, p)).where(F.col("item_id").isNotNull())
    # The larger measure wins, of equals the smaller item; both are found where the sums are.
    best = lambda measure: F.max(F.when(F.col(measure).isNotNull(), F.struct(F.col(measure).alias("value"), (-F.col("item_id")).alias("order"))))
    return sums.groupBy("year_month").agg(best("quantity").alias("by_quantity"), best("subtotal").alias("by_subtotal"))


def results(sums: DataFrame, best: DataFrame, menu: DataFrame, stores: DataFrame, users: DataFrame, homes: DataFrame, p: Params, value: str, unique: bool = False) -> DataFrame:
    """The five results as rows of ``RESULT``, from (written) :func:`tagged_sums` and :func:`best_products`."""
    row = lambda df, query, *columns: df.select(F.lit(query).alias("query"), *(c.cast("string").alias(n) for c, n in zip(columns, ("first", "second", "third"), strict=True)))
    none, col = F.lit(None), F.col
    one = row(sums.where("tag = 'kept'"), "1", col("transaction_id"), col("amount"), none)

    of_users = sums.where("tag = 'user'")
    tpv = aggregates.stores_tpv(of_users.where("in_hours").select("year_half", "user_id", "tpv"), homes)
    three = row(lookups.store_names(tpv, stores, unique), "3", col("year_half"), col("store_name"), col("tpv").cast("double"))
    counts = aggregates.stores_purchases(of_users.groupBy("user_id").agg(F.sum("purchases").alias("purchases")), homes)
    top = ranking.top_k(counts, ["store_id"], [col("purchases").desc(), col("user_id").desc()], p.top)
    four = row(lookups.birthdates(lookups.store_names_or_id(top, stores, unique), users, value, unique), "4", col("store_name"), col(value), none)

    winners = best.select("year_month", F.explode(F.array(*(F.struct(F.lit(q).alias("query"), col(f"{c}.order").alias("order"), col(f"{c}.value").alias("value")) for q, c in (("2_1", "by_quantity"), ("2_2", "by_subtotal"))))).alias("x"))
    named = lookups.item_names(winners.where("x.value is not null").select("year_month", "x.query", (-col("x.order")).alias("item_id"), "x.value"), menu, unique)
    measure = F.when(col("query") == "2_1", col("value").cast("bigint").cast("string")).otherwise(col("value").cast("double").cast("string"))
    two = named.select("query", col("year_month").alias("first"), col("item_name").alias("second"), measure.alias("third"))
    return one.unionByName(two).unionByName(three).unionByName(four)
