"""All queries by name, each over (spark, folder), and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar, numbers
from ..operators import aggregates, filters, lookups, ranking, sets
from ..sources import files
from ..sources.schemas import TABLES
from ..sources.scratch import file_system, hadoop_path, scratch
from ..streaming import changed, publish, running
from . import retail
from .bindings import EVENT_YEARS, ORDER_YEARS, Tables
from .catalog import EVENTS, EVENTS_IN, HOURS, ITEMS_IN, ORDERS, ORDERS_IN, QUERIES, SQL, query, years, yh, ym

__all__ = ["QUERIES", "SQL"]


def name_files(spark: SparkSession, folder: str, name: str) -> None:
    """Give the files that Spark wrote into ``folder`` names that tell the table."""
    files_there = file_system(spark, folder)
    for i, status in enumerate(files_there.listStatus(hadoop_path(spark, folder))):
        if status.getPath().getName().startswith("part-"):
            files_there.rename(status.getPath(), hadoop_path(spark, f"{folder}/{name}_{i}.csv"))


# The four questions.


def _q1_sql(where: str) -> str:
    return f"select event_id as transaction_id, value as final_amount from events where {where}"


@query(_q1_sql(f"{EVENTS_IN} and {HOURS} and value >= 75"))
def q1_events(spark: SparkSession, folder: str) -> DataFrame:
    return retail.q1(Tables(spark, folder).events, EVENT_YEARS)


def _q2_sql(measure: str, out: str, kind: str) -> str:
    return f"""with a as (select l_partkey as item_id, {ym("l_shipdate")} as ym, sum(cast({measure} as decimal(28,6))) as v from lineitem where {ITEMS_IN} group by 1, 2),
    r as (select *, row_number() over (partition by ym order by v desc, item_id asc) as rn from a)
    select ym as year_month_created_at, coalesce(p_name, 'UNKNOWN') as item_name, cast(v as {kind}) as {out} from r left join part on item_id = p_partkey where rn = 1"""


@query(_q2_sql("l_quantity", "sellings_qty", "bigint"))
def q2_1_best_selling(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return retail.q2_1(t.items, t.menu, ORDER_YEARS, unique=True)


@query(_q2_sql("l_extendedprice", "profit_sum", "double"))
def q2_2_most_profit(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return retail.q2_2(t.items, t.menu, ORDER_YEARS, unique=True)


def _tpv_sql(source: str, ts: str, amount: str, where: str) -> str:
    return f"select {yh(ts)} as year_half, cast(c_nationkey as bigint) as store_id, sum(cast({amount} as decimal(28,6))) as v from {source} where {where} and c_nationkey is not null group by 1, 2"


def _q3_sql(inner: str, value: str = "cast(v as double)") -> str:
    return f"with t as ({inner}) select year_half as year_half_created_at, coalesce(n_name, 'UNKNOWN') as store_name, {value} as tpv from t left join nation on store_id = n_nationkey"


ORDERS_TPV = _tpv_sql(ORDERS, "o_orderdate", "o_totalprice", ORDERS_IN)


@query(_q3_sql(ORDERS_TPV))
def q3_tpv(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return retail.q3(t.orders, t.stores, ORDER_YEARS, hours=False, unique=True, homes=t.homes)


@query(_q3_sql(ORDERS_TPV, "case when substring(split_part(printf('%.4f', cast(v as double)), '.', 2), 3, 1) = '5' then cast(printf('%.4f', cast(v as double)) as double) - 0.001 else round(cast(v as double), 2) end"))
def q3_tpv_rounded(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return retail.q3(t.orders, t.stores, ORDER_YEARS, hours=False, rounded=True, unique=True, homes=t.homes)


@query(_q3_sql(_tpv_sql(EVENTS, "ts", "value", f"{EVENTS_IN} and {HOURS}")))
def q3_tpv_events(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return retail.q3(t.events, t.stores, EVENT_YEARS, unique=True, homes=t.homes)


def _top3_sql(source: str, user: str, where: str) -> str:
    return f"""a as (select cast(c_nationkey as bigint) as store_id, {user} as user_id, count(*) as purchases from {source} where {where} and {user} is not null and c_nationkey is not null group by 1, 2),
    r as (select *, row_number() over (partition by store_id order by purchases desc, user_id desc) as rn from a)"""


def _q4_sql(source: str, user: str, where: str) -> str:
    return f"""with {_top3_sql(source, user, where)}
    select coalesce(n_name, concat('NO_JOINER_DATA_', cast(store_id as string))) as store_name, c_name as user_name
    from r left join nation on store_id = n_nationkey left join customer on user_id = c_custkey where rn <= 3"""


@query(_q4_sql(ORDERS, "o_custkey", ORDERS_IN))
def q4_top3_users(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return retail.q4(t.orders, t.stores, t.users, ORDER_YEARS, "user_name", unique=True, homes=t.homes)


@query(_q4_sql(EVENTS, "user_id", EVENTS_IN))
def q4_top3_users_events(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return retail.q4(t.events, t.stores, t.users, EVENT_YEARS, "user_name", unique=True, homes=t.homes)


# Filters.


@query(_q1_sql(years("ts", 2024, 2024)))
def filter_year(spark: SparkSession, folder: str) -> DataFrame:
    return filters.by_year(Tables(spark, folder).events, "created_at", 2024, 2024).select("transaction_id", "final_amount")


@query(_q1_sql(HOURS))
def filter_hour(spark: SparkSession, folder: str) -> DataFrame:
    return filters.by_hour(Tables(spark, folder).events, "created_at", 6, 23).select("transaction_id", "final_amount")


@query(_q1_sql("value >= 75"))
def filter_amount(spark: SparkSession, folder: str) -> DataFrame:
    return filters.by_amount(Tables(spark, folder).events, "final_amount", 75).select("transaction_id", "final_amount")


@query("select event_id as transaction_id, user_id from (select event_id, case when event_id % 7 <> 0 then user_id end as user_id from events) where user_id is not null")
def filter_not_null(spark: SparkSession, folder: str) -> DataFrame:
    events = Tables(spark, folder).events.withColumn("user_id", F.when(F.col("transaction_id") % 7 != 0, F.col("user_id")))
    return filters.not_null(events, "user_id").select("transaction_id", "user_id")


# Derived columns and parsing.


@query(f"select o_orderkey as transaction_id, {yh('o_orderdate')} as year_half from orders")
def derive_year_half(spark: SparkSession, folder: str) -> DataFrame:
    return Tables(spark, folder).orders.select("transaction_id", calendar.year_half(F.col("created_at")).alias("year_half"))


@query(f"select o_orderkey as transaction_id, {ym('o_orderdate')} as year_month, cast(date_trunc('month', o_orderdate) as timestamp) as month_start from orders")
def derive_year_month(spark: SparkSession, folder: str) -> DataFrame:
    ts = F.col("created_at")
    return Tables(spark, folder).orders.select("transaction_id", calendar.year_month(ts).alias("year_month"), calendar.month_start(ts).alias("month_start"))


@query(
    """select o_orderkey as transaction_id, case when ok then cast(year(o_orderdate) as integer) end as year, case when ok then cast(case when month(o_orderdate) <= 6 then 1 else 2 end as integer) end as half,
    case when ok then cast(month(o_orderdate) as integer) end as month from (select *, o_orderkey % 5 <> 0 as ok from orders)"""
)
def parse_period(spark: SparkSession, folder: str) -> DataFrame:
    """Keys as text, a fifth of them broken, and read back."""
    ts, ok = F.col("created_at"), F.col("transaction_id") % 5 != 0
    half = calendar.parse_year_half(F.when(ok, calendar.year_half(ts)).otherwise("1997-H3"))
    month = calendar.parse_year_month(F.when(ok, calendar.year_month(ts)).otherwise("1997-13"))
    rows = Tables(spark, folder).orders.select("transaction_id", half.alias("h"), month.alias("m"))
    return rows.select("transaction_id", F.col("h.year").alias("year"), F.col("h.half").alias("half"), F.col("m.month").alias("month"))


@query(
    """select event_id as transaction_id, case event_id % 7 when 2 then null when 3 then strftime(ts, '%Y-%m-%d %H:%M:%S.%f') when 4 then strftime(ts, '%Y-%m-%d 00:00:00.000000') when 6 then strftime(ts, '%Y-%m-%d %H:%M:00.000000')
    else strftime(ts, '%Y-%m-%d %H:%M:%S.000000') end as created_at from events"""
)
def parse_ts(spark: SparkSession, folder: str) -> DataFrame:
    """ISO text, with a space, no time at all, parts of a second, a day alone, an offset, no seconds."""
    ts, kind = F.col("created_at"), F.col("transaction_id") % 7
    shapes = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", None, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss'+02:00'", "yyyy-MM-dd HH:mm"]
    text = F.lit("not a time")
    for i, shape in enumerate(shapes):
        if shape:
            text = F.when(kind == i, F.date_format(ts, shape)).otherwise(text)
    return Tables(spark, folder).events.select("transaction_id", F.date_format(calendar.parse_ts(text), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"))


@query("select event_id as transaction_id, case when event_id % 4 = 3 then null else cast(cast(value as decimal(18,2)) as double) end as amount from events")
def parse_decimal_comma(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts with a comma, a point, or neither."""
    cents, kind = numbers.cents(F.col("final_amount")).cast("string"), F.col("transaction_id") % 4
    text = F.when(kind == 3, "x,y").when(kind == 0, cents).otherwise(F.replace(cents, F.lit("."), F.lit(",")))
    return Tables(spark, folder).events.select("transaction_id", numbers.parse_decimal_comma(text).alias("amount"))


# Projections.


@query("select o_orderkey as transaction_id, cast(c_nationkey as bigint) as store_id, o_custkey as user_id, o_totalprice as final_amount, o_orderdate as created_at from orders join customer on o_custkey = c_custkey")
def project_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return files.project(Tables(spark, folder).store_orders, "transactions")


@query("select l_orderkey as transaction_id, l_partkey as item_id, l_quantity as quantity, l_extendedprice as subtotal, l_shipdate as created_at from lineitem")
def project_items(spark: SparkSession, folder: str) -> DataFrame:
    return files.project(Tables(spark, folder).items, "transaction_items")


@query("select p_partkey as item_id, p_name as item_name from part")
def project_menu(spark: SparkSession, folder: str) -> DataFrame:
    return files.project(Tables(spark, folder).menu, "menu_items")


@query("select cast(n_nationkey as bigint) as store_id, n_name as store_name from nation")
def project_stores(spark: SparkSession, folder: str) -> DataFrame:
    return files.project(Tables(spark, folder).stores, "stores")


@query("select c_custkey as user_id, c_name as user_name from customer")
def project_users(spark: SparkSession, folder: str) -> DataFrame:
    return Tables(spark, folder).users


# Aggregations.


@query(
    f"select l_partkey as item_id, {ym('l_shipdate')} as year_month, cast(sum(cast(l_quantity as decimal(28,6))) as bigint) as quantity, cast(sum(cast(l_extendedprice as decimal(28,6))) as double) as subtotal from lineitem group by 1, 2"
)
def agg_products(spark: SparkSession, folder: str) -> DataFrame:
    sums = aggregates.products(Tables(spark, folder).items)
    return sums.select("item_id", "year_month", F.col("quantity").cast("bigint").alias("quantity"), F.col("subtotal").cast("double").alias("subtotal"))


@query(f"select cast(c_nationkey as bigint) as store_id, o_custkey as user_id, count(*) as purchases from {ORDERS} group by 1, 2")
def agg_purchases(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return aggregates.purchases_of_homes(t.orders, t.homes)


@query(f"select year_half, store_id, cast(v as double) as tpv from ({_tpv_sql(ORDERS, 'o_orderdate', 'o_totalprice', 'true')})")
def agg_tpv(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return aggregates.tpv_of_homes(t.orders, t.homes).withColumn("tpv", F.col("tpv").cast("double"))


@query(
    f"select {yh('ts')} as year_half, user_id, cast(sum(case event_id % 1000 when 1 then cast(100000000000000000 as decimal(28,6)) when 2 then null else cast(value / 1000 as decimal(28,6)) end) as varchar) as tpv from events where user_id is not null group by 1, 2"
)
def agg_tpv_subcent(spark: SparkSession, folder: str) -> DataFrame:
    """Users' sums of amounts below a cent, some huge, some not finite."""
    kind = F.col("transaction_id") % 1000
    amount = F.when(kind == 1, F.lit(1e17)).when(kind == 2, F.lit(float("inf"))).otherwise(F.col("final_amount") / 1000)
    rows = Tables(spark, folder).events.withColumn("final_amount", amount)
    return aggregates.tpv(rows, "user_id").withColumn("tpv", F.col("tpv").cast("string"))


# Ranking.


def _argmax_sql(measure: str, out: str, kind: str) -> str:
    return f"""with a as (select l_partkey as item_id, {ym("l_shipdate")} as year_month, sum(cast({measure} as decimal(28,6))) as v from lineitem group by 1, 2)
    select item_id, year_month, cast(v as {kind}) as {out} from a qualify row_number() over (partition by year_month order by v desc, item_id) = 1"""


@query(_argmax_sql("l_quantity", "quantity", "bigint"))
def argmax_qty(spark: SparkSession, folder: str) -> DataFrame:
    best = ranking.argmax(aggregates.products(Tables(spark, folder).items), ["year_month"], "quantity", "item_id")
    return best.select("item_id", "year_month", F.col("quantity").cast("bigint").alias("quantity"))


@query(_argmax_sql("l_extendedprice", "subtotal", "double"))
def argmax_profit(spark: SparkSession, folder: str) -> DataFrame:
    best = ranking.argmax(aggregates.products(Tables(spark, folder).items), ["year_month"], "subtotal", "item_id")
    return best.select("item_id", "year_month", F.col("subtotal").cast("double").alias("subtotal"))


@query(f"with {_top3_sql(ORDERS, 'o_custkey', 'true')} select store_id, user_id, purchases from r where rn <= 3")
def top3(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return ranking.top3_users(aggregates.purchases_of_homes(t.orders, t.homes))


# Lookups, with dimensions that lack some keys and names.


@query("select p_partkey as item_id, case when p_partkey % 3 = 0 then 'UNKNOWN' when p_partkey % 3 = 1 then '' else p_name end as item_name from part")
def join_items(spark: SparkSession, folder: str) -> DataFrame:
    menu = Tables(spark, folder).menu
    dim = menu.where(F.col("item_id") % 3 != 0).withColumn("item_name", F.when(F.col("item_id") % 3 == 2, F.col("item_name")))
    return lookups.item_names(menu.select("item_id"), dim).select("item_id", "item_name")


@query(f"select year_half, store_id, cast(v as double) as tpv, case when store_id % 3 = 2 then n_name else 'UNKNOWN' end as store_name from ({ORDERS_TPV}) join nation on store_id = n_nationkey")
def join_stores_tpv(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    sums = aggregates.tpv_of_homes(retail.in_years(t.orders, ORDER_YEARS), t.homes).withColumn("tpv", F.col("tpv").cast("double"))
    return lookups.store_names(sums, _some_stores(t)).select("year_half", "store_id", "tpv", "store_name")


def _some_stores(t: Tables) -> DataFrame:
    """A third of the stores is absent, a third has no name."""
    return t.stores.where(F.col("store_id") % 3 != 0).withColumn("store_name", F.when(F.col("store_id") % 3 == 2, F.col("store_name")))


@query(f"with {_top3_sql(ORDERS, 'o_custkey', 'true')} select store_id, user_id, case when store_id % 3 = 2 then n_name else concat('NO_JOINER_DATA_', cast(store_id as string)) end as store_name from r join nation on store_id = n_nationkey where rn <= 3")
def join_stores_top3(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    best = ranking.top3_users(aggregates.purchases_of_homes(t.orders, t.homes))
    return lookups.store_names_or_id(best, _some_stores(t)).select("store_id", "user_id", "store_name")


@query(f"with {_top3_sql(ORDERS, 'o_custkey', 'true')} select store_id, user_id, case when user_id % 2 = 1 then c_name end as user_name from r join customer on user_id = c_custkey where rn <= 3")
def join_users(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    best = ranking.top3_users(aggregates.purchases_of_homes(t.orders, t.homes))
    return lookups.birthdates(best, t.users.where(F.col("user_id") % 2 == 1), "user_name").select("store_id", "user_id", "user_name")


# Sets.


@query(_q1_sql(f"{EVENTS_IN} and {HOURS} and value >= 75"))
def q1_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """The first question over events that all come twice."""
    rows = retail.q1(Tables(spark, folder).events, EVENT_YEARS)
    return sets.distinct_first(rows.unionByName(rows), "transaction_id", [F.col("final_amount")])


@query(
    f"""with b as ({_q1_sql("value >= 75")}), r as ({_q1_sql(HOURS)})
    select 'missing' as side, transaction_id, final_amount from (select * from b except select * from r) union all select 'extra', transaction_id, final_amount from (select * from r except select * from b)"""
)
def except_compare(spark: SparkSession, folder: str) -> DataFrame:
    return sets.compare(filter_amount(spark, folder), filter_hour(spark, folder)).select("side", "transaction_id", "final_amount")


# Sources and sinks.


@query("select 'events' as name, count(*) as rows from events union all select 'lineitem', count(*) from lineitem union all select 'orders', count(*) from orders")
def scan_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each table, added up over its files."""
    out = None
    for name in ("events", "lineitem", "orders"):
        one = files.scan_stats(files.read_parquet_table(spark, folder, name)).agg(F.sum("rows").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def _transaction_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Events as lines of the transactions file."""
    e, none = Tables(spark, folder).store_events, F.lit(None).cast("string")
    return e.select(
        F.col("transaction_id").cast("string").alias("transaction_id"), F.concat(F.col("store_id").cast("string"), F.lit(".0")).alias("store_id"), none.alias("payment_method_id"), none.alias("voucher_id"),
        F.concat(F.col("user_id").cast("string"), F.lit(".0")).alias("user_id"), none.alias("original_amount"), none.alias("discount_applied"), F.col("final_amount").cast("string").alias("final_amount"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )


SCAN_SQL = "select cast(event_id as varchar) as transaction_id, cast(c_nationkey as bigint) as store_id, user_id, value as final_amount, date_trunc('second', ts) as created_at from events join customer on user_id = c_custkey"


@query(SCAN_SQL)
def scan_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Written as CSV in the shape of the transactions file (ids like ``12.0``, empty fields), and read by the scan."""
    path = scratch(spark)
    _transaction_lines(spark, folder).write.options(header="true").csv(f"{path}/2024")
    name_files(spark, f"{path}/2024", "Transactions")
    # A table that the scan has to leave alone.
    Tables(spark, folder).stores.select(*(F.col("store_name").alias(c) for c, _ in TABLES["stores"])).write.options(header="true").csv(f"{path}/dims")
    name_files(spark, f"{path}/dims", "stores")
    return files.project(files.read_csv_table(spark, path, "transactions"), "transactions")


@query(_q3_sql(ORDERS_TPV))
def sink_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The third question's result file, read back."""
    path = scratch(spark)
    files.write_result_csv(q3_tpv(spark, folder), path, ["year_half_created_at", "store_name"])
    return spark.read.schema("year_half_created_at string, store_name string, tpv double").csv(path, header=True)


# Streams.


@query(_argmax_sql("l_quantity", "quantity", "bigint"))
def stream_argmax_qty(spark: SparkSession, folder: str) -> DataFrame:
    """Products' sums over a stream of line items, ranked at the end of each batch."""
    rows = _stream(spark, folder, "lineitem")
    items = rows.select(F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("subtotal"), F.col("l_shipdate").alias("created_at"))
    path = scratch(spark)
    best = lambda sums: ranking.argmax(sums, ["year_month"], "quantity", "item_id").select("item_id", "year_month", F.col("quantity").cast("bigint").alias("quantity"))
    running.run_available(aggregates.products(items), best, f"{path}/best", f"{path}/checkpoint")
    return publish.latest(spark, f"{path}/best")


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream; as a pattern, its path can be a file as well as a folder."""
    source = f"{folder}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(source).schema).parquet(source[:-1] + "[t]")


def _order_stream(spark: SparkSession, folder: str) -> DataFrame:
    o = _stream(spark, folder, "orders")
    return o.select(F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("final_amount"), F.col("o_orderdate").alias("created_at"))


@query(_q3_sql(ORDERS_TPV))
def stream_tpv(spark: SparkSession, folder: str) -> DataFrame:
    """The third question over a stream of orders: users' sums are the state, and what a batch changes is written."""
    t, path = Tables(spark, folder), scratch(spark)

    def finish(sums: DataFrame) -> DataFrame:
        named = lookups.store_names(aggregates.stores_tpv(sums, t.homes), t.stores, True)
        return named.select(F.col("year_half").alias("year_half_created_at"), "store_name", F.col("tpv").cast("double").alias("tpv"))

    changed.run_changes(aggregates.tpv(retail.in_years(_order_stream(spark, folder), ORDER_YEARS), "user_id"), ["year_half", "user_id"], f"{path}/tpv", f"{path}/checkpoint")
    return finish(changed.current(spark, f"{path}/tpv", ["year_half", "user_id"]))


@query(f"with {_top3_sql(ORDERS, 'o_custkey', 'true')} select store_id, user_id, purchases from r where rn <= 3")
def stream_top3(spark: SparkSession, folder: str) -> DataFrame:
    """The ranking of the fourth question over a stream of orders."""
    t, path = Tables(spark, folder), scratch(spark)
    changed.run_changes(aggregates.purchases_of_users(_order_stream(spark, folder)), ["user_id"], f"{path}/counts", f"{path}/checkpoint")
    return ranking.top3_users(aggregates.stores_purchases(changed.current(spark, f"{path}/counts", ["user_id"]), t.homes))


from . import continuous  # noqa: E402, F401  its queries are registered as well
