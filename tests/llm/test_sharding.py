import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F
from tillroll.llm import queries, sharding


def shards(df, shards=4, **more):
    out = sharding.shuffle_into_shards(df, "doc_id", shards, F.coalesce(F.octet_length("text"), F.lit(0)), **more)
    return out.select("record.doc_id", "record.text", "shard", "slot")


def test_nothing_lost_and_slots_gapless(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for bucket_bytes in (1 << 30, 20_000):
        rows = shards(docs, 4, bucket_bytes=bucket_bytes).collect()
        assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in docs.collect())
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_order_is_shuffled_and_repeatable(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one = sorted((r["shard"], r["slot"], r["doc_id"]) for r in shards(docs).collect())
    again = sorted((r["shard"], r["slot"], r["doc_id"]) for r in shards(docs.repartition(5)).collect())
    other = sorted((r["shard"], r["slot"], r["doc_id"]) for r in shards(docs, seed=1).collect())
    assert one == again != other
    ids = [d for s, _, d in one if s == 0]
    assert ids != sorted(ids)


def test_one_more_shard_takes_rows_only_into_itself(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = {r["doc_id"]: r["shard"] for r in shards(docs, 24).collect()}
    after = {r["doc_id"]: r["shard"] for r in shards(docs, 25).collect()}
    assert all(after[d] in (before[d], 24) for d in before)
    rows = queries.op1_sharding(spark, small).collect()
    assert {r["doc_id"]: r["shard"] for r in rows} == before
    assert {r["doc_id"]: r["grown_shard"] for r in rows} == after


def test_odd_rows(odd, odd_rows, none):
    rows = shards(odd, 3, bucket_bytes=1000).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r[0], r[1]) for r in odd_rows)
    assert len({r["shard"] for r in rows if r["doc_id"] == 5}) == 1
    assert shards(none).count() == 0
    assert sharding.shuffle_into_shards(odd, "doc_id", 2).select("record.*").columns == odd.columns


def plain_shard(key, shards, seed=sharding.SEED):
    """Rendezvous hashing with the public XXH64; hashes count as signed numbers."""

    def draw(i):
        h = 42  # Spark's seed
        for value, width in ((seed, 4), (key, 8), (i, 4)):
            h = xxhash.xxh64_intdigest(value.to_bytes(width, "little", signed=True), h)
        return h - (1 << 64) if h >> 63 else h

    return max((draw(i), i) for i in range(shards))[1]


def test_query_by_loops(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op1_sharding(spark, small).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    slots = defaultdict(list)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        want = (len(raw) + 8, zlib.crc32(raw), "key", plain_shard(r["doc_id"], 24), plain_shard(r["doc_id"], 25))
        assert (r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) == want
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_equal_rows_spread(spark):
    """A third of all rows equal: they take all buckets of their shard, and none is lost."""
    docs = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("doc_id"), F.lit("four").alias("text"))
    out = sharding.shuffle_into_shards(docs, "doc_id", 2, F.octet_length("text"), bucket_bytes=4000).withColumn("task", F.spark_partition_id())
    tasks = out.groupBy("shard", "task").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("record.doc_id") == -1, 1)).alias("same")).collect()
    assert sum(t["n"] for t in tasks) == 60_000 and max(t["n"] for t in tasks) < 3000
    assert {t["shard"] for t in tasks if t["same"]} == {plain_shard(-1, 2)} and max(t["same"] for t in tasks) < 1500
    slots = out.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("d"), F.min("slot").alias("a"), F.max("slot").alias("b")).collect()
    assert all(s["n"] == s["d"] == s["b"] + 1 and s["a"] == 0 for s in slots)


def test_buckets_are_runs_of_cells(spark):
    """Sizes of the tasks are even, also where cells don't divide into buckets; too few cells are refused."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("four").alias("text"))
    out = sharding.shuffle_into_shards(docs, "doc_id", 2, F.octet_length("text"), bucket_bytes=4000, cells=37)
    tasks = out.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(tasks) == 20 and sum(t["n"] for t in tasks) == 20_000
    assert max(t["n"] for t in tasks) < 4 * 20_000 / 37 / 2 * 1.2  # four cells of the 37 at most
    with pytest.raises(ValueError, match="cells"):
        sharding.shuffle_into_shards(docs, "doc_id", 2, F.octet_length("text"), bucket_bytes=4000, cells=9)


def test_written_shards(spark, odd, tmp_path):
    shuffled = sharding.shuffle_into_shards(odd, "doc_id", 3)
    sharding.write_shards(shuffled, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    got = back.select("doc_id", "text", "_first_k", "__shard", "__slot", "map").collect()
    want = shuffled.select("record.doc_id", "record.text", "record._first_k", "shard", "slot", "record.map").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


def test_native(spark, small):
    plan = queries.op1_sharding(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
