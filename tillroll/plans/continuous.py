"""Queries of sources that keep coming, and of what the scan tells beside its rows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import exact
from ..operators import aggregates, filters, lookups
from ..sources import files
from ..sources.schemas import TABLES
from ..sources.scratch import file_system, hadoop_path, names, scratch
from ..streaming import incremental, late, later, periods, running
from . import clients, retail, together
from .bindings import EVENT_YEARS, ORDER_YEARS, Tables
from .catalog import EVENTS, EVENTS_IN, HOURS, ITEMS_IN, ORDERS, ORDERS_IN, query, years, yh, ym


def sales(spark: SparkSession, folder: str) -> DataFrame:
    return files.read_parquet_table(spark, folder, "sales")


def arrive(rows: DataFrame, inbox: str, parts: int = 1) -> None:
    """A delivery: ``rows`` as more files of a folder that a stream watches."""
    rows.repartition(parts).write.mode("append").parquet(inbox)


def watch(spark: SparkSession, inbox: str, rows: DataFrame, **options) -> DataFrame:
    return spark.readStream.schema(rows.schema).options(**options).parquet(inbox)


# Rows that come late or twice.

DELAY = timedelta(days=7)
#: Even months are delivered before odd ones, a fifth of them twice.
EVEN = "month(sold_at) % 2 = 0"


@query(
    f"""with first as (select max(sold_at) - interval 7 days as horizon from sales where {EVEN})
    select sale_id, client_id, total, sold_at, coalesce(not {EVEN} and sold_at < horizon, false) as late from sales, first"""
)
def stream_late(spark: SparkSession, folder: str) -> DataFrame:
    """Sales in two deliveries out of order, the second with repetitions of the first: every sale once, those that came late marked."""
    path, rows = scratch(spark), sales(spark, folder).select("sale_id", "client_id", "total", "sold_at")
    first = F.coalesce(F.month("sold_at") % 2 == 0, F.lit(False))
    for delivery in (rows.where(first), rows.where(~first | (F.col("sale_id") % 5 == 0))):
        arrive(delivery, f"{path}/inbox", 3)
        late.append_once(watch(spark, f"{path}/inbox", rows), "sale_id", "sold_at", DELAY, f"{path}/once", f"{path}/checkpoint")
    return late.written(spark, f"{path}/once").select("sale_id", "client_id", "total", "sold_at", "late")


@query(f"select event_id as transaction_id, value as final_amount from events where {EVENTS_IN} and {HOURS} and value >= 75")
def stream_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """The first question over a stream of several batches, in which every event comes twice, in another batch."""
    path, events = scratch(spark), Tables(spark, folder).events
    kept = filters.by_amount(retail.in_hours(retail.in_years(events, EVENT_YEARS), EVENT_YEARS), "final_amount", EVENT_YEARS.min_amount)
    arrive(events, f"{path}/inbox", 2)
    arrive(events, f"{path}/inbox", 2)
    stream = watch(spark, f"{path}/inbox", events, maxFilesPerTrigger=1)
    kept = filters.by_amount(retail.in_hours(retail.in_years(stream, EVENT_YEARS), EVENT_YEARS), "final_amount", EVENT_YEARS.min_amount)
    late.append_once(kept, "transaction_id", "created_at", timedelta(hours=1), f"{path}/once", f"{path}/checkpoint")
    return late.written(spark, f"{path}/once").select("transaction_id", "final_amount")


# Sums of months that are over.

CLOSED = "date_trunc('month', sold_at) + interval 1 month + interval 14 days <= (select max(sold_at) from sales)"


@query(f"select {ym('sold_at')} as year_month, status, count(*) as sales, cast(sum(cast(total as decimal(28,6))) as double) as total from sales where {CLOSED} group by 1, 2")
def stream_month_closed(spark: SparkSession, folder: str) -> DataFrame:
    """Sales of each month and status in deliveries as they arrived; a month is given once, 14 days after its end."""
    path, rows = scratch(spark), sales(spark, folder)
    month = F.coalesce(F.month("arrived_at"), F.lit(1))
    for low, high in ((1, 2), (3, 3), (4, 12)):
        arrive(rows.where(month.between(low, high)), f"{path}/inbox", 2)
        sums = [F.count(F.lit(1)).alias("sales"), F.sum(exact(F.col("total"))).cast("double").alias("total")]
        months = periods.closed_months(watch(spark, f"{path}/inbox", rows), "sold_at", "14 days", ["status"], sums)
        progress = running.append_available(months, f"{path}/closed", f"{path}/checkpoint")
        if periods.dropped_rows(progress):
            raise ValueError("sales came more than 14 days late: their months had been closed")
    return spark.read.parquet(f"{path}/closed").select("year_month", "status", "sales", "total")


# A dimension that comes after the facts.

#: A third of the items never comes, a third has no name.
ITEM_NAME = "case when i.item_id is null or s.item_id % 3 = 0 then 'UNKNOWN' when s.item_id % 3 = 1 then '' else coalesce(i.name, '') end"


@query(f"select s.sale_id, s.line_no, s.item_id, {ITEM_NAME} as item_name from sale_lines s left join items i on s.item_id = i.item_id where s.item_id is not null")
def stream_join_items(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of sales first, then the items that they name; lines whose item hasn't come in time are given without."""
    path = scratch(spark)
    at = lambda c: c.cast("timestamp").alias("at")
    lines = files.read_parquet_table(spark, folder, "sale_lines").select("sale_id", "line_no", "item_id", at(F.coalesce("shipped_at", F.to_timestamp_ntz(F.lit("2024-01-01")))))
    offered = files.read_parquet_table(spark, folder, "items").where(F.col("item_id") % 3 != 0)
    entries = offered.select("item_id", F.when(F.col("item_id") % 3 == 2, F.col("name")).alias("item_name"), at(F.to_timestamp_ntz(F.lit("2024-06-01"))))
    end = at(F.to_timestamp_ntz(F.lit("2100-01-01")))  # a row without a key, which moves the time on

    def deliver(facts: DataFrame, dimension: DataFrame) -> None:
        arrive(facts, f"{path}/lines", 2)
        arrive(dimension, f"{path}/items")
        joined = later.join_later(watch(spark, f"{path}/lines", lines), watch(spark, f"{path}/items", entries), "item_id", "item_name", "at", "200 days", F.lit("UNKNOWN"), F.lit(""))
        running.append_available(joined.select("sale_id", "line_no", "item_id", "item_name"), f"{path}/joined", f"{path}/checkpoint")

    deliver(lines, entries.where("false"))
    deliver(lines.where("false"), entries)
    tick = lambda df: spark.range(1).select(*(end if f.name == "at" else F.lit(-1).cast(f.dataType).alias(f.name) for f in df.schema))
    deliver(tick(lines), tick(entries))
    return spark.read.parquet(f"{path}/joined").where("item_id >= 0 or sale_id >= 0")


# Sums over files that keep coming.


@query(f"select l_partkey as item_id, {ym('l_shipdate')} as year_month, cast(sum(cast(l_quantity as decimal(28,6))) as bigint) as quantity, cast(sum(cast(l_extendedprice as decimal(28,6))) as double) as subtotal from lineitem group by 1, 2")
def agg_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Products' sums in three runs over a growing folder; one file is offered again from another place."""
    path, items = scratch(spark), Tables(spark, folder).items
    read = lambda paths: spark.read.schema(items.drop("transaction_id").schema).parquet(*paths)
    folders = []
    for run in range(3):
        folders.append(f"{path}/inbox/{run}")
        arrive(items.where(F.pmod(F.xxhash64("transaction_id"), F.lit(3)) == run), folders[-1], 2)
        if run == 1:  # a copy of a file that the first run has read
            again = f"{path}/inbox/again"
            source = next(n for n in names(spark, folders[0]) if n.startswith("part-"))
            here = file_system(spark, path)
            here.mkdirs(hadoop_path(spark, again))
            spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(here, hadoop_path(spark, f"{folders[0]}/{source}"), here, hadoop_path(spark, f"{again}/{source}"), False, spark.sparkContext._jsc.hadoopConfiguration())
            folders.append(again)
        incremental.update(spark, f"{path}/store", folders, read, aggregates.products, aggregates.merged_products)
    sums = incremental.totals(spark, f"{path}/store", aggregates.merged_products)
    return sums.select("item_id", "year_month", F.col("quantity").cast("bigint").alias("quantity"), F.col("subtotal").cast("double").alias("subtotal"))


# All results together.


def _best_sql(query_name: str, measure: str, kind: str) -> str:
    return f"""select '{query_name}' as query, ym as first, coalesce(p_name, 'UNKNOWN') as second, cast(cast(v as {kind}) as varchar) as third from (
    select l_partkey as item_id, {ym("l_shipdate")} as ym, sum(cast({measure} as decimal(28,6))) as v, row_number() over (partition by {ym("l_shipdate")} order by sum(cast({measure} as decimal(28,6))) desc, l_partkey) as rn
    from lineitem where {ITEMS_IN} group by 1, 2) left join part on item_id = p_partkey where rn = 1"""


@query(
    f"""select query, first, second, case when query in ('2_2', '3') then printf('%.2f', cast(third as double)) else third end as third from (
    select '1' as query, cast(o_orderkey as varchar) as first, cast(cast(o_totalprice as decimal(18,2)) as varchar) as second, null as third from orders where {ORDERS_IN} and o_totalprice >= 75
    union all {_best_sql("2_1", "l_quantity", "bigint")} union all {_best_sql("2_2", "l_extendedprice", "double")}
    union all select '3', yh, coalesce(n_name, 'UNKNOWN'), cast(cast(v as double) as varchar) from (
        select {yh("o_orderdate")} as yh, c_nationkey, sum(cast(o_totalprice as decimal(28,6))) as v from {ORDERS} where {ORDERS_IN} and c_nationkey is not null group by 1, 2) left join nation on c_nationkey = n_nationkey
    union all select '4', coalesce(n_name, concat('NO_JOINER_DATA_', cast(c_nationkey as varchar))), c_name, null from (
        select c_nationkey, o_custkey, c_name, row_number() over (partition by c_nationkey order by count(*) desc, o_custkey desc) as rn
        from {ORDERS} where {ORDERS_IN} and c_nationkey is not null group by 1, 2, 3) left join nation on c_nationkey = n_nationkey where rn <= 3)"""
)
def all_results(spark: SparkSession, folder: str) -> DataFrame:
    """The five results as rows of one table; orders have days without hours, so all hours count."""
    t, path = Tables(spark, folder), scratch(spark)
    p = ALL_HOURS
    together.tagged_sums(t.orders, p).write.partitionBy("tag").parquet(f"{path}/sums")
    out = together.results(spark.read.parquet(f"{path}/sums"), together.best_products(t.items, p), t.menu, t.stores, t.users, t.homes, p, "user_name", unique=True)
    money = lambda c: F.format_string("%.2f", F.col(c).cast("double"))
    return out.withColumn("second", F.when(F.col("query") == "1", money("second")).otherwise(F.col("second"))).withColumn("third", F.when(F.col("query").isin("2_2", "3"), money("third")).otherwise(F.col("third")))


ALL_HOURS = type(ORDER_YEARS)(year_start=ORDER_YEARS.year_start, year_end=ORDER_YEARS.year_end, hour_start=0)


# What a scan tells beside its rows.


def store_lines(t: Tables, *columns: Column) -> DataFrame:
    """Stores as lines of the stores file."""
    given = {"store_id": F.col("store_id").cast("string"), "store_name": F.col("store_name")}
    return t.stores.select(*columns, *(given.get(c, F.lit(None).cast("string")).alias(c) for c, _ in TABLES["stores"]))


def event_lines(t: Tables, *columns: Column) -> DataFrame:
    """Events as lines of the transactions file; amounts are whole hundredths, so their text is the same everywhere."""
    given = {
        "transaction_id": F.col("transaction_id").cast("string"), "user_id": F.concat(F.col("user_id").cast("string"), F.lit(".0")),
        "final_amount": F.round(F.col("final_amount") * 100).cast("bigint").cast("string"), "created_at": F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"),
    }
    return t.events.select(*columns, *(given.get(c, F.lit(None).cast("string")).alias(c) for c, _ in TABLES["transactions"]))


def write_lines(lines: DataFrame, folder: str, name: str, key: str) -> None:
    """One file for each value of the column ``part``, ``<folder>/part=<value>/<name>``, its lines in the order of ``key``."""
    spark = lines.sparkSession
    lines.repartition("part").sortWithinPartitions("part", F.col(key).cast("bigint")).write.mode("append").options(header="true").partitionBy("part").csv(folder)
    here = file_system(spark, folder)
    for part in names(spark, folder):
        for file in names(spark, f"{folder}/{part}"):
            if file.startswith("part-"):
                here.rename(hadoop_path(spark, f"{folder}/{part}/{file}"), hadoop_path(spark, f"{folder}/{part}/{name}"))


@query("select cast(event_id as varchar) as transaction_id, cast(event_id % 3 as varchar) as part, row_number() over (partition by event_id % 3 order by event_id) as line from events")
def scan_position(spark: SparkSession, folder: str) -> DataFrame:
    """The file and the line of every transaction, also where a file is read in pieces."""
    path = scratch(spark)
    write_lines(event_lines(Tables(spark, folder), (F.col("transaction_id") % 3).cast("string").alias("part")), path, "transactions.csv", "transaction_id")
    rows = files.with_line_numbers(files.read_csv_positions(spark, path, "transactions"))
    return rows.select("transaction_id", F.regexp_extract("position.folder", "part=([0-9]+)$", 1).alias("part"), "line")


@query("select cast(n_nationkey as bigint) as store_id, case when n_nationkey % 4 = 0 then concat('second ', n_name) when n_nationkey % 4 = 1 then concat('third ', n_name) else n_name end as store_name from nation")
def join_newest(spark: SparkSession, folder: str) -> DataFrame:
    """Stores whose names come in several files, some of them anew: the last one that is read counts."""
    path, t = scratch(spark), Tables(spark, folder)
    renamed = lambda text: F.concat(F.lit(text), F.col("store_name")).alias("store_name")
    write_lines(store_lines(t, F.lit("a").alias("part")), path, "stores.csv", "store_id")
    for part, text, kept in (("b", "second ", F.col("store_id") % 4 < 2), ("b-c", "third ", F.col("store_id") % 4 == 1)):
        write_lines(store_lines(t, F.lit(part).alias("part")).where(kept).withColumn("store_name", renamed(text)), path, "stores.csv", "store_id")
    entries = files.read_csv_positions(spark, path, "stores")
    return lookups.lookup(t.stores.select("store_id"), entries, "store_id", "store_name", newest="position").select("store_id", "store_name")


_LINE = "concat(cast(event_id as varchar), ',,,,', coalesce(concat(cast(user_id as varchar), '.0'), ''), ',,,', {amount}, ',', {time})"
_CENTS, _TIME = "cast(cast(round(value * 100) as bigint) as varchar)", "strftime(ts, '%Y-%m-%d %H:%M:%S')"
_LINE_FULL = _LINE.format(amount=_CENTS, time=_TIME)


@query(
    f"""select case event_id % 10 when 0 then concat(cast(event_id as varchar), ',,,,', coalesce(concat(cast(user_id as varchar), '.0'), ''), ',,,', {_CENTS}) when 1 then concat({_LINE_FULL}, ',more')
    when 2 then {_LINE.format(amount="concat(" + _CENTS + ", ' EUR')", time=_TIME)} else {_LINE.format(amount="'many'", time="'yesterday'")} end as line,
    case event_id % 10 when 0 then 'too few fields' when 1 then 'too many fields' when 2 then 'final_amount is no real' else 'final_amount is no real; created_at is no time' end as reasons from events where event_id % 10 < 4"""
)
def scan_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions of which four in ten lines are short, long or broken: these lines, as they stand in the file."""
    path, kind = scratch(spark), F.col("transaction_id").cast("bigint") % 10
    lines = event_lines(Tables(spark, folder))
    lines = lines.withColumn("final_amount", F.when(kind == 2, F.concat("final_amount", F.lit(" EUR"))).when(kind == 3, "many").otherwise(F.col("final_amount")))
    lines = lines.withColumn("created_at", F.when(kind == 3, "yesterday").otherwise(F.col("created_at")))
    texts = [F.coalesce(F.col(c), F.lit("")) for c in lines.columns]
    text = F.when(kind == 0, F.concat_ws(",", *texts[:-1])).when(kind == 1, F.concat_ws(",", *texts, F.lit("more"))).otherwise(F.concat_ws(",", *texts))
    # A header stands first in every file.
    lines.select(text.alias(",".join(lines.columns))).write.options(header="true", quote="", sep="\x01").csv(f"{path}/raw")
    here = file_system(spark, path)
    for i, file in enumerate(n for n in names(spark, f"{path}/raw") if n.startswith("part-")):
        here.rename(hadoop_path(spark, f"{path}/raw/{file}"), hadoop_path(spark, f"{path}/raw/transactions_{i}.csv"))
    sound, rejects = files.split_csv_table(spark, path, "transactions")
    return rejects.select("line", F.array_join("reasons", "; ").alias("reasons"))


@query(
    f"""select 'transactions' as name, 3 as files, count(*) as rows, cast(sum(length({_LINE_FULL}) + 1) as bigint) as bytes from events
    union all select 'stores', 1, count(*), cast(sum(strlen(concat(cast(n_nationkey as varchar), ',', n_name, ',,,,,,')) + 1) as bigint) from nation"""
)
def scan_observed(spark: SparkSession, folder: str) -> DataFrame:
    """Files, rows and bytes of two tables, told by the scan that answers another question."""
    path, t = scratch(spark), Tables(spark, folder)
    write_lines(event_lines(t, (F.col("transaction_id") % 3).cast("string").alias("part")), path, "transactions.csv", "transaction_id")
    write_lines(store_lines(t, F.lit("s").alias("part")), path, "stores.csv", "store_id")
    told = []
    for table in ("transactions", "stores"):
        rows, seen = files.observed_csv_table(spark, path, table)
        rows.write.parquet(f"{path}/typed/{table}")  # the one read
        told.append((table, len(seen.get["files"]), seen.get["rows"], seen.get["bytes"]))
    return spark.createDataFrame(told, "name string, files int, rows long, bytes long")


# Clients.


@query(
    f"""select cast(event_id % 3 as varchar) as client, yh as year_half_created_at, coalesce(n_name, 'UNKNOWN') as store_name, cast(v as double) as tpv from (
    select event_id % 3 as event_id, {yh("ts")} as yh, c_nationkey, sum(cast(value as decimal(28,6))) as v from {EVENTS} where {EVENTS_IN} and {HOURS} and c_nationkey is not null group by 1, 2, 3) left join nation on c_nationkey = n_nationkey"""
)
def q3_clients(spark: SparkSession, folder: str) -> DataFrame:
    """The third question for three clients; one of them is computed again, and its results alone are replaced."""
    path, t = scratch(spark), Tables(spark, folder)
    t.events.withColumn("client", F.col("transaction_id") % 3).write.partitionBy("client").parquet(f"{path}/clients")
    for some in (None, ["1"]):
        rows = clients.read_clients(spark, f"{path}/clients", some)
        clients.replace_results(clients.tpv_of_clients(rows, t.stores, EVENT_YEARS, t.homes, unique=True), f"{path}/results")
    return spark.read.parquet(f"{path}/results").select(F.col("client").cast("string").alias("client"), "year_half_created_at", "store_name", "tpv")


# A source that is read at a bounded rate.


@query(f"select cast(event_id as varchar) as transaction_id, user_id, {_CENTS}::double as final_amount, date_trunc('second', ts) as created_at from events")
def stream_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions as a stream of CSV files, two in a batch; what has been read moves to an archive."""
    path = scratch(spark)
    write_lines(event_lines(Tables(spark, folder), (F.col("transaction_id") % 6).cast("string").alias("part")), f"{path}/inbox", "transactions.csv", "transaction_id")
    rows = files.stream_csv_table(spark, f"{path}/inbox", "transactions", files=2, archive=f"{path}/archive")
    progress = running.append_available(rows.select("transaction_id", "user_id", "final_amount", "created_at"), f"{path}/rows", f"{path}/checkpoint")
    if sum(p["numInputRows"] > 0 for p in progress) < 3:
        raise ValueError("six files make three batches")
    return spark.read.parquet(f"{path}/rows")
