"""The applier against a plain fold over all changes, and its parts by loops."""

import datetime
import math
import zlib
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tillroll.llm import changes, queries

COLUMNS = ["change_id", "client_id", "status", "batch", "missed", "city", "cents", "current"]


def fold(rows, batches=10, patience=8):
    """rows: (batch, day, id, client, n, op, city, balance).  What became of each, by id: client, status, batch, missed, city, balance, current."""
    following, held, value, out, last = defaultdict(lambda: 1), defaultdict(dict), defaultdict(lambda: (None, None)), {}, {}

    def apply(client, batch, missed):
        while (n := following[client]) in held[client]:
            _, key, op, city, balance = held[client].pop(n)
            was = value[client]
            value[client] = (city, balance) if op == "I" else (None, None) if op == "D" else tuple(y if x is None else x for x, y in zip((city, balance), was, strict=True))
            out[key] = [client, "applied", batch, missed, *value[client], False]
            last[client] = key, op
            missed, following[client] = 0, n + 1

    def jump(batch, now):
        for client in list(held):
            while held[client] and min(r[0] for r in held[client].values()) + patience <= now:
                to = min(held[client])
                missed, following[client] = to - following[client], to
                apply(client, batch, missed)

    now = -(10**9)
    for batch in range(1, batches + 1):
        jump(batch, now)
        here = sorted((r for r in rows if r[0] == batch), key=lambda r: (r[1], r[2]))
        for _, day, key, client, n, op, city, balance in here:
            if n < following[client] or n in held[client]:
                out[key] = [client, "rejected", batch, 0, None, None, False]
            else:
                held[client][n] = (day, key, op, city, balance)
                apply(client, batch, 0)
        now = max([now, *(r[1] for r in here)])
    jump(batches + 1, math.inf)
    for key, op in last.values():
        out[key][6] = op != "D"
    return out


def test_table_by_fold(spark, small):
    rows = [r for r in spark.read.parquet(f"{small}/client_changes.parquet").distinct().collect()]
    sequences = defaultdict(set)
    for r in rows:
        sequences[r["client_id"]].add(r["seq"])
    rank = {c: {q: i for i, q in enumerate(sorted(s), 1)} for c, s in sequences.items()}
    plain = []
    for r in rows:
        h = zlib.crc32(str(r["change_id"]).encode())
        if r["valid_at"] is not None and h % 11:
            day = (r["valid_at"] - datetime.datetime(1970, 1, 1)).days + 5 * (h % 4)
            plain.append((min(10, 1 + math.floor((day - 19723) * 10 / 160)), day, r["change_id"], r["client_id"], rank[r["client_id"]][r["seq"]], r["op"], r["city"], r["balance"]))
    want = {k: [*v[:5], None if v[5] is None else math.floor(100 * v[5] + 0.5), v[6]] for k, v in fold(plain).items()}
    df = queries.op13_changes(spark, small)
    assert df.columns == COLUMNS
    assert {r["change_id"]: list(r)[1:] for r in df.collect()} == want
    assert len(want) > 1000 and {v[2] for v in want.values()} == set(range(1, 12))


ODD = [
    # batch, day, id, client, n, op, city, balance
    (1, 10, 1, 1, 1, "I", "A", 1.0),
    (1, 10, 2, 1, 3, "U", None, 3.0),  # waits for 2
    (1, 11, 3, 1, 3, "U", "C", None),  # a repetition in the same batch
    (1, 9, 4, None, 2, "U", "N", None),  # of the null client, waits for 1
    (3, 30, 5, 1, 2, "D", None, None),  # still in time, as batch 2 is empty
    (3, 30, 6, 2, 5, "I", "E", 0.005),
    (3, 31, 7, 2, 9000, "D", None, None),  # on another page
    (3, 29, 8, 2, 9000, "I", "F", None),  # comes before the row above
    (4, 30, 9, 3, 2, "?", "G", 7.0),
    (4, 60, 10, 3, 1, "I", "H", None),
    (4, 60, None, 4, 1, "U", "no id", None),
    (4, 22, 11, 5, 4, "I", "due on arrival", -0.005),  # older than the time: jumped when the next batch begins
]


def test_odd_rows_by_fold(spark):
    schema = "batch int, day int, id long, client long, n long, op string, city string, balance double, n_held int, page string, key int"
    df = spark.createDataFrame([(*r, 0, "x", 1) for r in ODD], schema)
    names = changes.Columns(id="id", client="client")
    applied = changes.latest_applied(changes.apply_changes(df, 5, names))
    got = {r["id"]: [None if r["no_client"] else r["client"], r["status"], r["batch"], r["missed"], r["city"], r["balance"], r["current"]] for r in applied.collect()}
    want = fold([(*r[:2], -1 if r[2] is None else r[2], *r[3:5], *(("U", None, None) if r[5] == "?" else r[5:])) for r in ODD], 5)
    want[None] = want.pop(-1)
    assert got == want
    assert got[7][1] == "rejected" and got[8][3] == 8994 and got[5][1] == "applied" and got[11][2] == 5


def test_no_store_stays_open(spark):
    """Each batch's start opens stores of its own; those of earlier starts must not add up in the executors."""
    local = Path(spark._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf()))
    stores = lambda: set(local.glob("StateStoreId*"))  # noqa: E731  a store's own files; they go when it is closed
    before = stores()
    df = spark.createDataFrame(ODD, "batch int, day int, id long, client long, n long, op string, city string, balance double")
    assert changes.apply_changes(df.where("batch = 1"), 1, changes.Columns(id="id", client="client")).count() == 4
    assert stores() <= before


def test_large_client_in_small_pages(spark):
    """One client with nearly all rows, over many pages of which few are held at once."""
    import random

    rng = random.Random(5)
    rows = []
    for i in range(1500):
        n = 1 + i // 2 if i % 3 else rng.randint(1, 900)
        batch = 1 + min(3, i // 400 + rng.randint(0, 1))
        rows.append((batch, batch * 10 + rng.randint(0, 9), i, 7 if i % 50 else i, n, rng.choice("IUD"), rng.choice([None, "x", "y"]), rng.choice([None, 1.5])))
    df = spark.createDataFrame(rows, "batch int, day int, change_id long, client_id long, n long, op string, city string, balance double")

    got = {r["id"]: [r["client"], r["status"], r["batch"], r["missed"], r["city"], r["balance"], r["current"]] for r in changes.latest_applied(changes.apply_changes(df, 4, page=16, loaded=2)).collect()}
    assert got == fold(rows, 4)


class Store(dict):
    """A map state without Spark."""

    loads = 0

    def getValue(self, key):
        self.loads += 1
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]


def test_only_touched_pages_load():
    store = Store()
    held = changes.Held(store, [], [], 10, 3)
    for n in range(5, 200):
        held.page(n)[n] = (100 - n // 50, n, "I", f"c{n}", n / 2, 1)
        held.mark(n)
        assert len(held.loaded) <= 3
    held.settle()
    assert set(store) == {(i,) for i in range(20)} and store.loads == 0
    assert held.days[0] == 100 and held.days[19] == 97
    again = changes.Held(store, list(held.days), list(held.days.values()), 10, 3)
    assert again.page(71)[71] == (99, 71, "I", "c71", 35.5, 1) and store.loads == 1
    assert again.smallest() == 5 and store.loads == 2
    again.page(75).clear()
    again.mark(75)
    again.settle()
    assert 7 not in again.days and (7,) not in store and store.loads == 2


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_ranks_by_loops(spark, parts):
    rows = [(c, q) for c in (None, 0, 1) for q in [None, -5, 3, 3, 8, *range(10, 200 if c == 1 else 20)]]
    df = spark.createDataFrame(rows, "client long, seq long").repartition(4)
    got = {(None if r["no_client"] else r["client"], r["sequence"]): r["n"] for r in changes.dense_ranks(df, F.col("client"), F.col("seq"), parts).collect()}
    for c in (None, 0, 1):
        mine = sorted({q for d, q in rows if d == c}, key=lambda q: (q is not None, q or 0))
        assert [got[c, q] for q in mine] == list(range(1, len(mine) + 1))


def test_empty(spark, small):
    none = spark.read.parquet(f"{small}/client_changes.parquet").where("1 = 0").selectExpr("*", "1 as n", "1 as day", "1 as batch")
    assert changes.latest_applied(changes.apply_changes(none, 2)).count() == 0
    assert changes.with_numbers(none.drop("n"), "client_id", "seq").count() == 0


class Handle:
    """What a processor sees of Spark's state, with the calls counted."""

    def __init__(self):
        self.calls, self.value, self.map = [], None, Store()

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, key, value):
        return self.map

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def registerTimer(self, at):
        self.calls.append("timer")

    def getCurrentWatermarkInMs(self):
        return 0


def test_state_calls_do_not_follow_clients():
    handle, batch = Handle(), 0
    for numbers in ([2], [1, 3]):
        batch += 1
        applier = changes.Applier(batch, 8)
        applier.init(handle)
        handle.calls.clear()
        rows = [(100 * c + n, c, False, n, "I", 20, f"c{n}", 1.0) for n in numbers for c in range(500)]
        names = Row(*changes.IN)
        got = list(applier.handleInputRows((0,), (names(*r) for r in rows), handle))
        assert len(got) == (0 if batch == 1 else 1500) and len(handle.calls) <= 3 and not handle.map
