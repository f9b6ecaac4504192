"""Deliveries, failures and repetitions: what the queries over one folder don't show."""

import os
import subprocess
import sys
from datetime import datetime, timedelta

import pytest
from helpers import oracle, same_rows
from pyspark.sql import functions as F
from tillroll.operators import aggregates, lookups
from tillroll.plans import clients, continuous, registry, retail, together
from tillroll.plans.bindings import EVENT_YEARS, ORDER_YEARS, Tables
from tillroll.sources import files
from tillroll.streaming import changed, incremental, late, later, periods, publish, running

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def at(text):
    return datetime.fromisoformat(text)


def failing(df, when):
    """``df``, of which some rows end the task when they are written."""
    return df.withColumn("x", F.when(when, F.raise_error(F.lit("stop here"))).otherwise(F.col("x")))


# Publication.


def test_failed_version_leaves_the_last_one(spark, tmp_path):
    target = str(tmp_path / "out")
    one, two = spark.range(100).select(F.col("id").alias("x")), spark.range(200).select(F.col("id").alias("x"))
    with pytest.raises(FileNotFoundError):
        publish.latest(spark, target)
    publish.publish(one, target, 0)
    with pytest.raises(Exception, match="stop here"):
        publish.publish(failing(two.repartition(4), F.col("x") == 150), target, 1)
    assert publish.latest(spark, target).count() == 100
    # Files of a run that was killed before its end, without a marker.
    two.write.mode("overwrite").parquet(publish.folder_of(target, 1))
    assert publish.complete_versions(spark, target) == [0] and publish.latest(spark, target).count() == 100
    publish.publish(two, target, 1)
    assert publish.latest(spark, target).count() == 200
    publish.publish(one, target, 1)  # it was finished already
    assert publish.latest(spark, target).count() == 200
    publish.publish(one, target, 2)
    assert publish.complete_versions(spark, target) == [1, 2]


def test_killed_batch_leaves_the_last_result(spark, tmp_path):
    """A stream whose second batch fails while it writes, then is run again."""
    inbox, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = spark.range(10).select(F.col("id").alias("x"), (F.col("id") % 2).alias("k"))
    rows.write.parquet(inbox)
    stream = lambda: spark.readStream.schema(rows.schema).parquet(inbox).groupBy("k").agg(F.sum("x").alias("x"))
    running.run_available(stream(), lambda df: df, target, checkpoint)
    first = sorted(map(tuple, publish.latest(spark, target).collect()))
    rows.write.mode("append").parquet(inbox)
    with pytest.raises(Exception, match="stop here"):
        running.run_available(stream(), lambda df: failing(df, F.col("k") == 1), target, checkpoint)
    assert sorted(map(tuple, publish.latest(spark, target).collect())) == first == [(0, 20), (1, 25)]
    running.run_available(stream(), lambda df: df, target, checkpoint)
    assert sorted(map(tuple, publish.latest(spark, target).collect())) == [(0, 40), (1, 50)]


# Late rows.

ROWS = "k string, t timestamp_ntz, x int"


def test_no_row_is_lost(spark, tmp_path):
    """The case that a watermark loses: a row from before the latest time, in a second batch."""
    target = str(tmp_path / "out")
    deliveries = [
        [("1", at("2024-01-02 12:00:00"), 1), ("1", at("2024-01-02 12:00:00"), 1), (None, at("2024-01-02 00:00:00"), 9), ("4", None, 4)],
        [("2", at("2024-01-01 06:00:00"), 2), ("3", at("2024-01-03 06:00:00"), 3), ("1", at("2024-01-02 12:00:00"), 1), (None, at("2024-01-02 00:00:00"), 9), ("4", None, 4), ("5", at("2024-01-02 11:30:00"), 5)],
        [],
        [("2", at("2024-01-01 06:00:00"), 2), ("6", at("2024-01-03 05:30:00"), 6), ("7", at("2024-01-03 04:30:00"), 7)],
    ]
    for number, rows in enumerate(deliveries):
        for _ in range(2):  # each is offered again, as after a failure
            late.add_once(spark.createDataFrame(rows, ROWS), "k", "t", timedelta(hours=1), target, number)
    got = {(r["k"], r["x"], r["late"]) for r in late.written(spark, target).collect()}
    assert got == {("1", 1, False), (None, 9, False), ("4", 4, False), ("2", 2, True), ("3", 3, False), ("5", 5, False), ("6", 6, False), ("7", 7, True)}
    assert late.written(spark, target).count() == len(got)


def test_failed_batch_is_written_anew(spark, tmp_path):
    target = str(tmp_path / "out")
    rows = spark.createDataFrame([(str(i), at("2024-01-01 00:00:00") + timedelta(hours=i), i) for i in range(100)], ROWS)
    with pytest.raises(Exception, match="stop here"):
        late.add_once(failing(rows, F.col("x") == 77), "k", "t", timedelta(hours=1), target, 0)
    late.add_once(rows, "k", "t", timedelta(hours=1), target, 0)
    assert late.written(spark, target).count() == 100


def test_only_own_days_are_read(spark, tmp_path):
    target = str(tmp_path / "out")
    rows = lambda day: spark.createDataFrame([("a", at(f"2024-01-{day:02d} 10:00:00"), day)], ROWS)
    for day in range(1, 6):
        late.add_once(rows(day), "k", "t", timedelta(days=1), target, day)
    seen = late._keys(rows(3).withColumn("day", F.to_date("t")), late.written(spark, target), "k", "day")
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((day#" in plan.replace("\n", "") or "PartitionFilters" in plan and "2024-01-03" in plan
    assert [tuple(r) for r in seen.collect()] == [("a", at("2024-01-03 00:00:00").date())]


# Months.


def test_a_month_is_given_once_and_not_early(spark, tmp_path):
    inbox, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "t timestamp_ntz, k string, x int"
    stream = lambda: spark.readStream.schema(schema).parquet(inbox)

    def deliver(*rows):
        spark.createDataFrame([(at(t), k, x) for t, k, x in rows], schema).write.mode("append").parquet(inbox)
        months = periods.closed_months(stream(), "t", "5 days", ["k"], [F.sum("x").alias("x")])
        progress = running.append_available(months, target, checkpoint)
        return sorted((r["year_month"], r["k"], r["x"]) for r in spark.read.schema("year_month string, k string, x bigint").parquet(target).collect()), periods.dropped_rows(progress)

    assert deliver(("2023-12-31 23:59:59.999999", "a", 1), ("2024-01-01 00:00:00", "a", 2), ("2024-01-05 23:59:59", "a", 4)) == ([], 0)
    december = [("2023-12", "a", 9), ("2023-12", "b", 16)]
    assert deliver(("2023-12-02 00:00:00", "a", 8), ("2023-12-30 00:00:00", "b", 16), ("2024-01-06 00:00:01", "a", 1)) == (december, 0)
    # A row of a closed month isn't added, but counted.
    assert deliver(("2023-12-03 00:00:00", "a", 100), ("2024-01-31 23:00:00", "b", 5))[1] == 1
    assert deliver(("2024-02-29 12:00:00", "a", 1))[0] == [*december, ("2024-01", "a", 7), ("2024-01", "b", 5)]
    assert deliver(("2024-03-06 12:00:00", "a", 1))[0] == [*december, ("2024-01", "a", 7), ("2024-01", "b", 5), ("2024-02", "a", 1)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_month_axis(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["1969-12-31 23:59:59.5", "1970-01-01 00:00:00", "2024-02-29 23:59:59.999999", "2024-03-10 02:30:00", "2024-12-31 00:00:00.000001", "1950-06-15 12:00:00"]
        df = spark.createDataFrame([(at(t),) for t in texts], "t timestamp_ntz").select("t", periods.month_axis(F.col("t")).alias("a"))
        rows = df.select("t", periods.month_of(F.col("a")).alias("m"), F.unix_micros("a").alias("u")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    for r in rows:
        start = r["t"].replace(day=1, hour=0, minute=0, second=0, microsecond=0)
        assert r["m"] == start
        assert r["u"] == ((start.year - 1970) * 12 + start.month - 1) * 31 * 86_400_000_000 + (r["t"] - start) // timedelta(microseconds=1)


# A later dimension.


def test_state_of_both_sides_is_bounded(spark, tmp_path):
    schema = "item_id bigint, x int, at timestamp"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "a"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "a"))
    joined = later.join_later(stream.drop("x"), stream, "item_id", "x", "at", "1 day", F.lit(0), F.lit(1))
    query = joined.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    plan = query._jsq.explainInternal(True)
    # Each side drops what the other can't reach any more.
    assert "StreamingSymmetricHashJoin" in plan and "left value predicate" in plan and "right value predicate" in plan


def test_facts_wait_for_their_entry(spark, tmp_path):
    facts, entries = "item_id bigint, n int, at timestamp", "item_id bigint, name string, at timestamp"
    paths = {n: str(tmp_path / n) for n in ("facts", "entries", "out", "state")}

    def deliver(new_facts, new_entries):
        spark.createDataFrame([(i, n, at(t)) for i, n, t in new_facts], facts).write.mode("append").parquet(paths["facts"])
        spark.createDataFrame([(i, n, at(t)) for i, n, t in new_entries], entries).write.mode("append").parquet(paths["entries"])
        left, right = spark.readStream.schema(facts).parquet(paths["facts"]), spark.readStream.schema(entries).parquet(paths["entries"])
        joined = later.join_later(left, right, "item_id", "name", "at", "2 days", F.lit("UNKNOWN"), F.lit(""))
        running.append_available(joined, paths["out"], paths["state"])
        return sorted((r["n"], r["name"]) for r in spark.read.schema("item_id bigint, n int, at timestamp, name string").parquet(paths["out"]).collect())

    day = "2024-01-{:02d} 00:00:00".format
    assert deliver([(1, 10, day(1)), (1, 11, day(1)), (2, 20, day(1)), (3, 30, day(1)), (None, 0, day(1))], []) == []
    assert deliver([], [(1, "one", day(2)), (2, None, day(2))]) == [(10, "one"), (11, "one"), (20, "")]
    # Time goes on in both streams: what still waits is given without an entry.
    assert deliver([(9, 90, day(9))], [(8, "eight", day(9))]) == [(10, "one"), (11, "one"), (20, ""), (30, "UNKNOWN")]


# Incremental sums.


def test_runs_read_new_files_only(spark, tmp_path):
    inbox, store = tmp_path / "in", str(tmp_path / "store")
    rows = spark.range(60).selectExpr("cast(id as string) as transaction_id", "id % 3 as item_id", "id as quantity", "id / 4 as subtotal", "timestamp_ntz'2024-01-31 10:00:00' as created_at")
    part = lambda n: rows.where(F.col("quantity") % 12 == n).coalesce(1)
    read_files = []

    def read(paths):
        df = spark.read.schema(rows.schema).parquet(*paths)
        read_files.append(sorted(df.inputFiles()))
        return df

    run = lambda partial=aggregates.products: incremental.update(spark, store, [str(inbox)], read, partial, aggregates.merged_products)
    totals = lambda: sorted((r["item_id"], int(r["quantity"]), float(r["subtotal"])) for r in incremental.totals(spark, store, aggregates.merged_products).collect())
    want = lambda *parts: sorted((i, sum(q for q in range(60) if q % 3 == i and q % 12 in parts), sum(q / 4 for q in range(60) if q % 3 == i and q % 12 in parts)) for i in range(3) if any(p % 3 == i for p in parts))
    part(0).write.parquet(str(inbox / "0"))
    assert len(run()) == 1 and totals() == want(0)
    assert run() == [] and publish.complete_versions(spark, store) == [0]
    part(1).write.parquet(str(inbox / "1"))
    with pytest.raises(Exception, match="stop here"):
        run(lambda df: failing(aggregates.products(df).withColumn("x", F.lit(1)), F.col("item_id") == 1).drop("x").where("x = 1"))
    assert totals() == want(0)
    assert len(run()) == 1 and totals() == want(0, 1)
    (copy,) = (inbox / "0").glob("part-*.parquet")
    (inbox / "again").mkdir()
    (inbox / "again" / copy.name).write_bytes(copy.read_bytes())
    assert run() == []
    for n in range(2, 12):  # more runs than stay unmerged
        part(n).write.parquet(str(inbox / str(n)))
        assert len(run()) == 1 and totals() == want(*range(n + 1))
    assert all(len(f) == 1 for f in read_files) and len({f[0] for f in read_files}) == 12
    assert len(publish.live_versions(spark, store)) < publish.COMPACT < len(publish.complete_versions(spark, store))


def test_sums_are_made_of_even_partitions(spark, tmp_path):
    """What is summed and what is merged has been dealt by all columns, so a file's rows, or a frequent key's, are no task of their own."""
    inbox, store, seen = str(tmp_path / "in"), str(tmp_path / "store"), []
    rows = spark.range(1000).selectExpr("if(id % 3 = 0, 7, id) as item_id", "id as quantity", "id / 4 as subtotal", "timestamp_ntz'2024-01-31 10:00:00' as created_at")
    rows.coalesce(1).write.parquet(inbox)

    def dealt(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]
        seen.append(all(c in plan for c in ("RebalancePartitions", *df.columns)))
        return df

    incremental.update(spark, store, [inbox], lambda paths: spark.read.schema(rows.schema).parquet(*paths), lambda df: aggregates.products(dealt(df)), aggregates.merged_products)
    sums = incremental.totals(spark, store, lambda df: aggregates.merged_products(dealt(df)))
    assert {r["item_id"]: int(r["quantity"]) for r in sums.collect()} == {7: 7 + sum(range(0, 1000, 3)), **{i: i for i in range(1000) if i % 3 and i != 7}}
    assert seen == [True, True]


# Changed sums.


def test_batches_write_what_changed(spark, tmp_path):
    inbox, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema, want = "k string, x bigint", {}
    spark.createDataFrame([], schema).write.parquet(inbox)

    def run(*rows, fail=False):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        sums = spark.readStream.schema(schema).parquet(inbox).groupBy("k").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
        changed.run_changes(failing(sums, F.col("k") == "bad") if fail else sums, ["k"], target, checkpoint)

    for batch in range(publish.COMPACT + 4):
        rows = [("a", batch), (f"k{batch}", 1), (None, 5)]
        for k, x in rows:
            total, n = want.get(k, (0, 0))
            want[k] = (total + x, n + 1)
        run(*rows)
        assert {r["k"]: (r["x"], r["n"]) for r in changed.current(spark, target, ["k"]).collect()} == want
    live = publish.live_versions(spark, target)
    assert len(live) < publish.COMPACT < len(publish.complete_versions(spark, target))
    assert spark.read.parquet(publish.folder_of(target, live[-1])).count() == 3
    assert spark.read.parquet(publish.folder_of(target, live[0])).count() > publish.COMPACT
    with pytest.raises(Exception, match="stop here"):
        run(("bad", 1), fail=True)
    assert {r["k"]: (r["x"], r["n"]) for r in changed.current(spark, target, ["k"]).collect()} == want
    run(("a", 1))
    assert {r["k"]: r["x"] for r in changed.current(spark, target, ["k"]).where("k in ('a', 'bad')").collect()} == {"a": want["a"][0] + 1, "bad": 1}


# All results.


def test_one_scan_of_each_fact_table(spark, small, tmp_path):
    t = Tables(spark, small)
    sums, best = together.tagged_sums(t.orders, ORDER_YEARS), together.best_products(t.items, ORDER_YEARS)
    for df in (sums, best):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1
    assert sums._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    out = registry.QUERIES["all_results"](spark, small)
    read = [f.rsplit("/", 1)[1] for f in out.inputFiles()]
    assert "orders.parquet" not in read and read.count("lineitem.parquet") == 1
    assert out._jdf.queryExecution().executedPlan().toString().count("lineitem.parquet") <= 1


def test_together_equals_each_alone(spark):
    rows = [
        (1, 7, 80.0, at("2024-01-01 05:59:59")), (2, 7, 80.0, at("2024-01-01 06:00:00")), (2, 7, 80.0, at("2024-01-01 06:00:00")), (3, 7, 10.0, at("2024-08-01 12:00:00")), (4, None, 99.0, at("2025-01-01 23:59:59")),
        (5, 8, None, at("2025-01-01 12:00:00")), (6, 8, 75.0, None), (7, 9, 75.0, at("2026-01-01 00:00:00")), (8, 6, 500.0, at("2025-03-01 12:00:00")),
    ]
    orders = spark.createDataFrame(rows, "transaction_id bigint, user_id bigint, final_amount double, created_at timestamp_ntz")
    items = spark.createDataFrame([("a", 2, 5, 1.0, at("2024-01-05 00:00:00")), ("b", 1, 5, 7.0, at("2024-01-06 00:00:00")), ("c", 2, 0, 3.0, at("2024-01-06 00:00:00")), ("d", None, 99, 99.0, at("2024-01-06 00:00:00")), ("e", 4, None, -1.0, at("2024-02-06 00:00:00"))], "transaction_id string, item_id bigint, quantity bigint, subtotal double, created_at timestamp_ntz")
    menu = spark.createDataFrame([(1, "bun")], "item_id bigint, item_name string")
    stores = spark.createDataFrame([(1, "Quay"), (2, None)], "store_id bigint, store_name string")
    users = spark.createDataFrame([(7, "Ann"), (6, "Bo")], "user_id bigint, user_name string")
    homes = spark.createDataFrame([(6, 1), (7, 1), (8, 2), (9, 1)], "user_id bigint, store_id bigint")
    got = together.results(together.tagged_sums(orders, EVENT_YEARS), together.best_products(items, EVENT_YEARS), menu, stores, users, homes, EVENT_YEARS, "user_name")
    text = lambda r: tuple(None if v is None else str(v) for v in r)
    found = {}
    for r in got.collect():
        found.setdefault(r["query"], []).append(text(r)[1:])
    same = lambda q, df: sorted(found.get(q, []), key=str) == sorted((text((*r, None, None))[:3] for r in df.collect()), key=str)
    assert same("1", retail.q1(orders, EVENT_YEARS).dropDuplicates(["transaction_id"]))
    assert same("2_1", retail.q2_1(items.where("item_id is not null and quantity is not null"), menu, EVENT_YEARS))
    assert same("2_2", retail.q2_2(items.where("item_id is not null"), menu, EVENT_YEARS))
    assert same("3", retail.q3(orders, stores, EVENT_YEARS, homes=homes))
    assert same("4", retail.q4(orders, stores, users, EVENT_YEARS, "user_name", homes=homes))


# Scans.


@pytest.fixture
def landing(tmp_path):
    head = "a,b,c,d,e,f,g,h\n"
    texts = {
        "z.d/stores.csv": head + "".join(f"{i},shop {i},,,,,,\n" for i in range(500)),
        "z.d/inner/stores.csv": head + "3,inner,,,,,,\n",
        "z/stores_2.csv": head + "1,second,,,,,,\n2,second,,,,,,\n",
        "z/stores_10.csv": head + "1,tenth,,,,,,\n2,tenth,,,,,,\n",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_positions_survive_splits(spark, landing):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = files.read_csv_positions(spark, landing, "stores")
        assert rows.select("position.split").distinct().count() > 5
        numbered = files.with_line_numbers(rows).collect()
        assert sorted((r["line"], r["store_id"]) for r in numbered if r["position"]["folder"].endswith("z.d")) == [(i + 1, i) for i in range(500)]
        facts = spark.createDataFrame([(1,), (2,), (3,), (4,)], "store_id bigint")
        named = lookups.lookup(facts, rows, "store_id", "store_name", newest="position").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    # Folders by name ("z" before "z.d"), inside them files by name ("stores_10" before "stores_2"), then inner folders.
    assert {r["store_id"]: r["store_name"] for r in named} == {1: "shop 1", 2: "shop 2", 3: "inner", 4: "shop 4"}
    ordered = rows.where("store_id in (1, 2, 3)").orderBy("position").collect()
    assert [(r["store_id"], r["store_name"]) for r in ordered][:4] == [(1, "tenth"), (2, "tenth"), (1, "second"), (2, "second")]


def test_every_line_is_row_or_reject(spark, tmp_path):
    lines = [
        "t1,1.0,2,,3,10.0,,9.5,2024-05-10 14:30:00", "t2,,,,,,,,", "t3,1,2", "t4,1,2,3,4,5,6,7,2024-05-10 14:30:00,more,and more", "t5,x,2,,3,10.0,,9.5,2024-05-10 14:30:00",
        't6,1,2,,3,1e3,,"9,5",2024-05-10', "t7,1,2,,3,10.0,,NaN,2024-13-10 14:30:00", ",,,,,,,,", "t8,1,2,,3,10,,9,2024-05-10 14:30:00,",
    ]
    (tmp_path / "Transactions_1.csv").write_text("any header\n" + "\n".join(lines) + "\n")
    sound, rejects = files.split_csv_table(spark, str(tmp_path), "transactions")
    bad = {r["line"]: (r["file"], r["reasons"]) for r in rejects.collect()}
    assert bad == {
        lines[2]: ("Transactions_1.csv", ["too few fields"]),
        lines[3]: ("Transactions_1.csv", ["too many fields"]),
        lines[4]: ("Transactions_1.csv", ["store_id is no whole"]),
        lines[5]: ("Transactions_1.csv", ["too many fields", "final_amount is no real", "created_at is no time"]),
        lines[6]: ("Transactions_1.csv", ["created_at is no time"]),
        lines[8]: ("Transactions_1.csv", ["too many fields"]),
    }
    assert sorted(str(r["transaction_id"]) for r in sound.collect()) == ["None", "t1", "t2"]
    assert sound.count() + rejects.count() == len(lines)


def test_observed_scan(spark, landing, tmp_path):
    rows, seen = files.observed_csv_table(spark, landing, "stores")
    assert rows.count() == 505
    assert rows.columns == [c for c, _ in files.TABLES["stores"]]
    rows, seen = files.observed_csv_table(spark, landing, "stores")
    rows.write.format("noop").mode("overwrite").save()
    told = seen.get
    bodies = [open(os.path.join(d, f)).read().split("\n", 1)[1] for d, _, names in os.walk(landing) for f in names]
    assert (told["rows"], told["bytes"], len(told["files"])) == (505, sum(map(len, bodies)), 4)
    rows, seen = files.observed_csv_table(spark, landing, "users")
    rows.write.format("noop").mode("overwrite").save()
    assert (seen.get["rows"], seen.get["bytes"], list(seen.get["files"])) == (0, 0, [])


# Clients.


def test_one_client_again(spark, small, tmp_path):
    t, root, target = Tables(spark, small), str(tmp_path / "in"), str(tmp_path / "out")
    t.events.withColumn("client", F.concat(F.lit("c"), F.col("transaction_id") % 3)).write.partitionBy("client").parquet(root)
    compute = lambda some=None: clients.replace_results(clients.tpv_of_clients(clients.read_clients(spark, root, some), t.stores, EVENT_YEARS, t.homes, unique=True), target)
    state = lambda c: {f: os.stat(f"{target}/client={c}/{f}").st_mtime_ns for f in os.listdir(f"{target}/client={c}")}
    compute()
    before = {c: state(c) for c in ("c0", "c1", "c2")}
    compute(["c1"])
    assert state("c0") == before["c0"] and state("c2") == before["c2"] and state("c1") != before["c1"]
    assert all(f.split("client=")[1].startswith("c1") for f in clients.read_clients(spark, root, ["c1"]).inputFiles())
    clients.cancel(spark, target, "c2")
    assert {r["client"] for r in spark.read.parquet(target).select("client").distinct().collect()} == {"c0", "c1"}


# Rate.


def test_what_was_read_is_archived(spark, tmp_path):
    inbox, archive = tmp_path / "in", tmp_path / "archive"
    inbox.mkdir()
    for i in range(5):
        (inbox / f"transactions_{i}.csv").write_text(f"h\nt{i},1,2,,4,1.0,,1.0,2024-05-10 14:30:00\n")
    rows = lambda: files.stream_csv_table(spark, str(inbox), "transactions", files=2, archive=str(archive))
    progress = running.append_available(rows(), str(tmp_path / "out"), str(tmp_path / "state"))
    assert [p["numInputRows"] for p in progress if p["numInputRows"]] == [2, 2, 1]
    (inbox / "transactions_9.csv").write_text("h\nt9,1,2,,4,1.0,,1.0,2024-05-10 14:30:00\n")
    running.append_available(rows(), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r["transaction_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["t0", "t1", "t2", "t3", "t4", "t9"]
    assert len([f for _, _, names in os.walk(archive) for f in names if f.endswith(".csv")]) >= 4


# Folders.

CHILD = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {folder!r}).getOrCreate()
from tillroll.plans import registry
assert registry.QUERIES["stream_top3"](spark, {small!r}).count() > 0
assert registry.QUERIES["stream_late"](spark, {small!r}).count() > 0
import os
assert any(n.startswith("retail-") for n in os.listdir({folder!r}))
spark.stop()
"""


def test_nothing_stays_in_the_shared_folder(small, tmp_path):
    subprocess.run([sys.executable, "-c", CHILD.format(folder=str(tmp_path), small=small)], check=True, cwd=ROOT, timeout=300, capture_output=True)
    # Spark makes an empty folder of its own there.
    assert [f for _, _, names in os.walk(tmp_path) for f in names] == [] and not any(n.startswith("retail-") for n in os.listdir(tmp_path))


MANY = ["q1_events", "q2_1_best_selling", "q2_2_most_profit", "q3_tpv", "q3_tpv_events", "q4_top3_users", "agg_products", "agg_tpv", "argmax_profit", "top3", "q1_distinct", "all_results", "stream_late", "stream_distinct"]


@pytest.fixture(scope="module")
def many(spark, small, tmp_path_factory):
    """The tables as folders of many small files, rows in another order."""
    folder = tmp_path_factory.mktemp("many")
    for name in ("events", "orders", "lineitem", "customer", "part", "nation", "sales"):
        spark.read.parquet(f"{small}/{name}.parquet").orderBy(F.rand(3)).repartition(13).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", MANY)
def test_many_files_in_any_order(spark, many, name):
    same_rows(registry.QUERIES[name](spark, many), oracle(many).sql(registry.SQL[name]))


def test_all_are_registered():
    assert {"stream_late", "stream_month_closed", "stream_join_items", "agg_incremental", "all_results", "scan_position", "join_newest", "scan_rejects", "scan_observed", "q3_clients", "stream_csv"} <= set(registry.QUERIES)
    assert continuous.DELAY == timedelta(days=7)
