"""Sequenced change applier (operator 13): changes of each client in the order of their numbers.

Changes of a client carry numbers 1, 2, 3, ... and arrive out of order, some
repeated, some never.  A change is *held* until all numbers before it are applied;
a number that is held or done already is rejected; numbers that stay away are
jumped when the oldest held change has waited long enough.

The state is kept by buckets of clients, as what a key of the state costs (calls to
Spark's store) is far more than what a client's few rows cost.  A bucket has about
``BUCKET_ROWS`` rows of the table; its clients' heads (next number, present values, and
which pages hold something since which day) are one Arrow blob, their held changes with
numbers under ``PAGE`` another.  Later numbers are in a paged map: a client's numbers are
divided into pages of ``PAGE``, a page's held changes are one blob beside the page's
smallest day.  Only pages that a batch touches are loaded, ``LOADED`` of a bucket at once,
so a client with a large share of all rows costs what its new rows touch, not what it
holds.  Waiting is an event-time timer on a bucket's smallest day; a bucket without new
or overdue changes isn't read at all.

Numbers are dense ranks of a sequence column, computed without a task for each
client: distinct (client, sequence) pairs are split into ranges, ranked inside them,
and the sizes of a client's earlier ranges are added.

Defined cases: a null client is a client of its own; a null sequence value ranks
first; a null time drops the row after ranking; of one number's rows in one batch
the one with the smallest (day, identifier), nulls last, counts; an operation other
than I, U and D changes nothing; an empty table gives no rows; columns other than
those named play no part.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from .common import cut, find_package, new_folder

#: Numbers of one page, and pages that are held in memory at once.
PAGE, LOADED = 4096, 64
#: Rows of the table for each bucket of clients.
BUCKET_ROWS = 1024
#: Days after which a held change no longer waits for the numbers before it.
PATIENCE = 8
DAY_MS = 86_400_000
#: A day after all days.
LAST_DAY = 2_900_000

BLOB = pa.schema([("n", pa.int64()), ("day", pa.int32()), ("id", pa.int64()), ("op", pa.string()), ("city", pa.string()), ("balance", pa.float64()), ("since", pa.int32())])
CLIENT = [("client", pa.int64()), ("no_client", pa.bool_())]
HEADS = pa.schema([*CLIENT, ("next", pa.int64()), ("city", pa.string()), ("balance", pa.float64()), ("pages", pa.list_(pa.int64())), ("days", pa.list_(pa.int32()))])
ROWS = pa.schema([*CLIENT, *BLOB])
BUCKET = "due long, batch int, heads binary, rows binary"
#: A row of the stream begins with these.
IN = ["id", "client", "no_client", "n", "op", "day", "city", "balance"]
Result = Row("id", "client", "no_client", "n", "op", "status", "batch", "missed", "city", "balance")
OUT = "id long, client long, no_client boolean, n long, op string, status string, batch int, missed long, city string, balance double"


@dataclass
class Columns:
    """Names of the columns of a table of changes; ``day`` is an int, ``batch`` the number of a row's batch."""

    id: str = "change_id"
    client: str = "client_id"
    n: str = "n"
    op: str = "op"
    day: str = "day"
    batch: str = "batch"
    city: str = "city"
    balance: str = "balance"


def pack(rows: list[tuple], schema: pa.Schema) -> bytes:
    """Rows as an Arrow blob."""
    columns = zip(*rows, strict=True) if rows else ((),) * len(schema)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as writer:
        writer.write_batch(pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> Iterator[tuple]:
    with pa.ipc.open_stream(blob) as reader:
        return zip(*(c.to_pylist() for c in reader.read_all().columns), strict=True)


class Held:
    """The held changes of one client: pages that are loaded when touched and written back when changed.

    ``first`` is page 0 where the caller keeps it; clients with the same ``recent``
    have ``most`` loaded pages together.
    """

    def __init__(self, store, pages: list[int], days: list[int], size: int = PAGE, most: int = LOADED, client: tuple = (), first: dict | None = None, recent: dict | None = None):
        self.store, self.size, self.most, self.client, self.first = store, size, most, client, first
        self.days = dict(zip(pages, days, strict=True))  # of pages that hold something, loaded or not
        self.stored = {p for p in pages if first is None or p}
        self.loaded: dict[int, dict[int, tuple]] = {}
        self.recent = {} if recent is None else recent  # (Held, page), the last one used comes last
        self.changed: set[int] = set()  # differ from what is stored
        self.stale: set[int] = set()  # may have another smallest day

    def page(self, n: int) -> dict[int, tuple]:
        """The page of a number: n -> (day, id, op, city, balance, since)"""
        number = n // self.size
        if not number and self.first is not None:
            return self.first
        found = self.loaded.get(number)
        if found is None:
            if len(self.recent) >= self.most:
                held, oldest = next(iter(self.recent))
                held.put(oldest)
            found = {}
            if number in self.stored:
                found = {r[0]: r[1:] for r in unpack(self.store.getValue((*self.client, number))[1])}
            self.loaded[number] = found
        self.recent.pop((self, number), None)
        self.recent[self, number] = None
        return found

    def holds(self, n: int) -> bool:
        """Whether the page of a number may hold something."""
        number = n // self.size
        return bool(self.first) if not number and self.first is not None else number in self.days or number in self.loaded

    def mark(self, n: int) -> None:
        """The page of a number differs from what is stored."""
        self.changed.add(n // self.size)
        self.stale.add(n // self.size)

    def refresh(self) -> None:
        """Bring ``days`` up to date with the loaded pages."""
        for number in self.stale:
            rows = self.first if not number and self.first is not None else self.loaded[number]
            if rows:
                self.days[number] = min(r[0] for r in rows.values())
            else:
                self.days.pop(number, None)
        self.stale.clear()

    def put(self, number: int) -> None:
        """Let go of a loaded page."""
        self.refresh()
        rows = self.loaded.pop(number)
        del self.recent[self, number]
        if number not in self.changed:
            return
        self.changed.discard(number)
        if rows:
            self.store.updateValue((*self.client, number), (self.days[number], pack([(n, *r) for n, r in rows.items()], BLOB)))
            self.stored.add(number)
        elif number in self.stored:
            self.store.removeKey((*self.client, number))
            self.stored.discard(number)

    def settle(self) -> None:
        self.refresh()
        for number in list(self.loaded):
            self.put(number)

    def smallest(self) -> int:
        """The smallest held number, after :meth:`refresh` or :meth:`settle`."""
        return min(self.page(min(self.days) * self.size))


@dataclass(slots=True)
class Client:
    key: tuple  # client, no_client
    next: int
    city: str | None
    balance: float | None
    held: Held


class Bucket:
    """The clients of one key of the state; those that a batch touches become :class:`Client`."""

    def __init__(self, store, stored: tuple | None, size: int = PAGE, most: int = LOADED):
        self.store, self.size, self.most = store, size, most
        self.due = stored[0] if stored is not None else None
        self.heads = {r[:2]: r[2:] for r in unpack(stored[2])} if stored is not None else {}
        self.firsts: dict[tuple, dict[int, tuple]] = defaultdict(dict)
        for r in unpack(stored[3]) if stored is not None else ():
            self.firsts[r[:2]][r[2]] = r[3:]
        self.touched: dict[tuple, Client] = {}
        self.recent: dict[tuple, None] = {}

    def client(self, key: tuple) -> Client:
        found = self.touched.get(key)
        if found is None:
            next_, city, balance, pages, days = self.heads.get(key, (1, None, None, [], []))
            held = Held(self.store, pages, days, self.size, self.most, key, self.firsts[key], self.recent)
            found = self.touched[key] = Client(key, next_, city, balance, held)
        return found

    def waiting(self, before: int) -> list[tuple]:
        """Clients that held a change of a day up to ``before`` when the bucket was read."""
        return [key for key, head in self.heads.items() if head[4] and min(head[4]) <= before]

    def settle(self, patience: int, batch: int) -> tuple:
        """What is stored, the smallest day's end of patience first."""
        for key, c in self.touched.items():
            c.held.settle()
            self.heads[key] = (c.next, c.city, c.balance, list(c.held.days), list(c.held.days.values()))
        days = [min(head[4]) for head in self.heads.values() if head[4]]
        self.due = (min(days) + patience) * DAY_MS if days else None
        rows = [(*key, n, *r) for key, first in self.firsts.items() for n, r in first.items()]
        return self.due, batch, pack([(*key, *head) for key, head in self.heads.items()], HEADS), pack(rows, ROWS)


def order(row: tuple) -> tuple:
    """Of rows with one number in one batch the smallest counts."""
    return (row[0], row[1] is None, row[1] or 0, row[2] or "", row[3] or "", row[4] or 0.0)


class Applier(StatefulProcessor):
    """Applies the changes of batch ``batch``, after what has become overdue by its beginning.

    The watermark is the time before the batch.  A bucket with new rows looks at it
    first; the others' timers expire in the same micro-batch.
    """

    def __init__(self, batch: int, patience: int, page: int = PAGE, loaded: int = LOADED):
        self.batch, self.patience, self.sizes = batch, patience, (page, loaded)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", BUCKET)
        self.pages = handle.getMapState("pages", "client long, no_client boolean, page long", "day int, rows binary")

    def close(self) -> None:
        pass

    def _finish(self, bucket: Bucket, timer: int | None) -> None:
        self.bucket.update(bucket.settle(self.patience, self.batch))
        if bucket.due is not None and bucket.due != timer:
            self.handle.registerTimer(max(0, bucket.due - 1))  # timers whose change was applied meanwhile are ignored when they expire

    def _jump(self, bucket: Bucket, now: int) -> Iterator[Row]:
        """While a client's change is overdue at ``now``, go on at its smallest held number."""
        overdue = now // DAY_MS - self.patience
        for key in bucket.waiting(overdue):
            client = bucket.client(key)
            while client.held.days and min(client.held.days.values()) <= overdue:
                smallest = client.held.smallest()
                missed, client.next = smallest - client.next, smallest
                yield from self._apply(client, missed)
                client.held.refresh()

    def _apply(self, client: Client, missed: int) -> Iterator[Row]:
        """Apply what is held from the next number on."""
        held = client.held
        while True:
            n = client.next
            row = held.page(n).pop(n, None) if held.holds(n) else None
            if row is None:
                return
            held.mark(n)
            _, id_, op, city, balance, _ = row
            if op == "I":
                client.city, client.balance = city, balance
            elif op == "U":
                client.city = client.city if city is None else city
                client.balance = client.balance if balance is None else balance
            elif op == "D":
                client.city = client.balance = None
            yield Result(id_, *client.key, n, op, "applied", self.batch, missed, client.city, client.balance)
            client.next = n + 1
            missed = 0

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rejected = lambda r, key, n: Result(r[1], *key, n, r[2], "rejected", self.batch, 0, None, None)
        bucket = timer = None
        new: dict[tuple, Client] = {}
        for r in rows:
            id_, client_id, no_client, n, op, day, city, balance = r[: len(IN)]
            if n is None:  # only moves the time on
                continue
            if bucket is None:
                bucket = Bucket(self.pages, self.bucket.get(), *self.sizes)
                timer = bucket.due
                yield from self._jump(bucket, timerValues.getCurrentWatermarkInMs())
            owner = (client_id, no_client)
            row = (day, id_, op, city, balance, self.batch)
            client = new[owner] = bucket.client(owner)
            if n < client.next:
                yield rejected(row, owner, n)
                continue
            page = client.held.page(n)
            other = page.get(n)
            if other is not None and (other[5] != self.batch or order(other) <= order(row)):
                yield rejected(row, owner, n)
                continue
            if other is not None:
                yield rejected(other, owner, n)
            page[n] = row
            client.held.mark(n)
        if bucket is not None:
            for client in new.values():
                yield from self._apply(client, 0)
            self._finish(bucket, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        stored, now = self.bucket.get(), timerValues.getCurrentWatermarkInMs()
        if stored is None or stored[0] is None or stored[0] > now:
            return  # its change was applied meanwhile
        if stored[1] == self.batch:  # overdue on arrival in this batch: its turn comes with the next, whose watermark is later
            self.handle.registerTimer(now)
            return
        bucket = Bucket(self.pages, stored, *self.sizes)
        yield from self._jump(bucket, now)
        self._finish(bucket, None)


def dense_ranks(df: DataFrame, client: Column, sequence: Column, parts: int) -> DataFrame:
    """client, no_client, sequence, n long: the rank of each distinct pair among its client's."""
    pairs = df.select(F.coalesce(client, F.lit(0)).alias("client"), client.isNull().alias("no_client"), sequence.alias("sequence")).distinct()
    keys = ["client", "no_client"]
    split = cut(pairs.repartitionByRange(parts, *keys, "sequence").withColumn("part", F.spark_partition_id()))
    sizes = split.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("size"))
    # A client has as many rows here as ranges.
    before = F.sum("size").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.row_number().over(Window.partitionBy(*keys, "part").orderBy("sequence"))
    offsets = sizes.select(*keys, "part", F.coalesce(before, F.lit(0)).alias("before"))
    return split.withColumn("inside", inside).join(offsets, [*keys, "part"]).select(*keys, "sequence", (F.col("before") + F.col("inside")).alias("n"))


def with_numbers(df: DataFrame, client: str, sequence: str, name: str = "n") -> DataFrame:
    """``df`` with the dense rank of each row's sequence value among its client's."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranks = dense_ranks(df, F.col(client), F.col(sequence), parts)
    same = (F.coalesce(F.col(client), F.lit(0)) == ranks["client"]) & (F.col(client).isNull() == ranks["no_client"]) & F.col(sequence).eqNullSafe(ranks["sequence"])
    return df.join(ranks, same).select(*(df[c] for c in df.columns), ranks["n"].alias(name))


def _run_batch(stream: DataFrame, processor: Applier, target: str, checkpoint: str) -> None:
    applied = stream.withWatermark("at", "0 seconds").groupBy("bucket").transformWithState(processor, OUT, "Append", "EventTime")
    query = applied.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def apply_changes(changes: DataFrame, batches: int, columns: Columns | None = None, patience: int = PATIENCE, page: int = PAGE, loaded: int = LOADED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """What became of each row of ``changes``: id, client, no_client, n, op, status, batch, missed, city, balance.

    Batches 1 to ``batches`` are fed one after the other to a stream that is started
    anew for each on one checkpoint; what still waits then is applied as batch ``batches + 1``
    (the last batch's rows carry a day after all days).
    """
    spark, c = changes.sparkSession, columns or Columns()
    find_package(spark)
    at = {f.name: F.col(f"`{getattr(c, f.name)}`") for f in fields(c)}
    rows = changes.select(
        at["id"].cast("long").alias("id"), F.coalesce(at["client"].cast("long"), F.lit(0)).alias("client"), at["client"].isNull().alias("no_client"), at["n"].cast("long").alias("n"),
        at["op"].alias("op"), at["day"].cast("int").alias("day"), at["city"].alias("city"), at["balance"].cast("double").alias("balance"), at["batch"].cast("int").alias("batch"),
    )
    folder = new_folder(spark, "changes")
    rows.write.partitionBy("batch").parquet(f"{folder}/batches")
    staged = spark.read.schema(rows.schema).parquet(f"{folder}/batches")
    told = staged.groupBy("batch").agg(F.max("day").alias("day"), F.count(F.lit(1)).alias("rows")).collect()
    latest, buckets = {r["batch"]: r["day"] for r in told}, 1 + sum(r["rows"] for r in told) // bucket_rows
    bucket = F.pmod(F.xxhash64("client", "no_client"), F.lit(buckets)).alias("bucket")
    session = _session(spark)
    day = 0
    for batch in range(1, batches + 2):
        # All rows of a batch carry its largest day so far as their time, so none is late, and the
        # watermark after it is that day (and some milliseconds, so that it always moves on).
        day = max(day, latest.get(batch, 0)) if batch < batches else LAST_DAY
        at = F.timestamp_millis(F.lit(day * DAY_MS + batch))
        timed = staged.where(F.col("batch") == batch).unionByName(_tick(staged)).select(*IN, bucket, at.alias("at"))
        timed.write.mode("append").parquet(f"{folder}/inbox")
        stream = session.readStream.schema(timed.schema).parquet(f"{folder}/inbox")
        _run_batch(stream, Applier(batch, patience, page, loaded), f"{folder}/applied", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/applied")


def _tick(like: DataFrame) -> DataFrame:
    """One row without a number, which only moves the time on; with it no batch is empty."""
    values = {"client": 0, "no_client": True}
    return like.sparkSession.range(1).select(*(F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in like.schema))


def _session(spark):
    """A session of its own for the stream's settings."""
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # many small stores: no room set aside for each
    session.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")  # each start opens stores of its own: those of earlier ones would stay in the executors' memory
    session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # overdue changes belong to the next batch
    return session


def latest_applied(applied: DataFrame) -> DataFrame:
    """``applied`` with ``current``: whether a row is its client's last applied one, and no deletion."""
    keys = ["client", "no_client"]
    last = applied.where("status = 'applied'").groupBy(*keys).agg(F.max("n").alias("n")).withColumn("is_last", F.lit(True))
    # Joined by number as well, so a client with many rows spreads over all tasks; rejected rows have no part in it.
    joined = applied.join(last, [*keys, "n"], "left")
    return joined.withColumn("current", F.coalesce(F.col("is_last") & (F.col("status") == "applied") & ~F.col("op").eqNullSafe(F.lit("D")), F.lit(False))).drop("is_last")
