"""Sharding (operator 1): a two-pass external shuffle, native.

Pass one scatters whole records over buckets of a size that fits in memory.  A
seeded hash of the key deals them: the shard by rendezvous hashing (of a
record's hashes with every shard's number the largest wins), and the bucket
inside the shard by a second hash.  Pass two takes each bucket by itself,
Fisher-Yates shuffles it in memory and appends it to its shard.  A record's
slot is the number of records in the shard's earlier buckets plus its place in
its own.

The law is ``key``: key and number of shards alone decide a record's shard, and
one more shard takes records only into itself (its number wins against the old
winner or not; nothing else changes).

The table is read twice.  The first reading counts rows and bytes in ``CELLS`` fixed
cells of each shard; their sum sets the number of buckets, and a bucket is a run of
cells, so its counts are sums as well.  The second one deals the records.  The
exchange carries each record once.  The first slots of the buckets come from
these counts and travel through the same exchange, so nothing is joined or
broadcast.  The cell depends on the whole record, so records with equal keys
spread; only rows that are equal in everything meet in one bucket.  Where a bucket
comes out ``HOT`` times too large, its rows are numbered in a written table and
dealt by their numbers over all buckets of the shard.

Defined cases: repeated keys share a shard, equal rows too, spread over its buckets;
a null key is a key like any other; null columns, maps and extra columns of any
name are carried along; an empty table gives no rows.  The slots depend on key,
seed and records alone, but where a bucket was too large also on the rows' order
in the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, row_hash

#: Bytes of records that one task shuffles in memory.
BUCKET_BYTES = 4 << 20
#: A bucket with so many times these bytes is dealt anew.
HOT = 4
#: Cells of a shard that are counted before the number of its buckets is known; a bucket is a run of them.
CELLS = 1 << 22
SEED = 42


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """Rendezvous hashing: the number of the shard whose hash with ``key`` is largest."""
    draws = [F.struct(F.xxhash64(F.lit(seed), key, F.lit(i)).alias("h"), F.lit(i).alias("i")) for i in range(shards)]
    return (F.greatest(*draws) if shards > 1 else draws[0])["i"]


def grown_shard_of(key: Column, shard: Column, shards: int, seed: int = SEED) -> Column:
    """The shard of a key, whose shard is known, when there is one shard more."""
    draw = lambda i: F.struct(F.xxhash64(F.lit(seed), key, i).alias("h"), i.alias("i"))
    return F.greatest(draw(shard), draw(F.lit(shards)))["i"]


def shuffle_into_shards(df: DataFrame, key_col: str, shards: int, size: Column | None = None, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, cells: int = CELLS) -> DataFrame:
    """record struct (all columns of ``df``), shard int, slot long.

    ``size`` gives a record's bytes and sets the number of buckets; without it
    a kilobyte each is assumed.  A shard has at most ``cells`` buckets, and a table
    that needs more of them is refused.
    """
    size = size if size is not None else F.lit(1024)
    key = F.col(f"`{key_col}`")
    dealt = df.select(
        F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("record"),
        size.cast("long").alias("size"),
        F.struct(F.xxhash64(F.lit(seed), key).alias("h"), row_hash(df).alias("tie")).alias("rank"),
        shard_of(key, shards, seed).alias("shard"),
    )
    dealt = dealt.select("*", F.pmod(F.xxhash64(F.lit(seed + 1), "rank"), F.lit(cells)).alias("cell"))
    counted = cut(dealt.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")))
    total = counted.agg(F.sum("b").alias("b")).first()["b"] or 0
    per_shard = max(1, -(-total // (bucket_bytes * shards)))
    if per_shard > cells:
        raise ValueError(f"{per_shard} buckets of {bucket_bytes} bytes in a shard, but {cells} cells")
    bucket = lambda part: (F.col("shard") * F.lit(per_shard) + part).cast("int").alias("bucket")
    of_cell = bucket(F.floor(F.col("cell") * F.lit(per_shard) / F.lit(cells)))
    dealt = dealt.select("*", of_cell).drop("cell")
    counts = counted.groupBy("shard", of_cell).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    hot = counts.where(F.col("b") > HOT * bucket_bytes).select("bucket")
    if per_shard > 1 and hot.limit(1).count():
        numbered = cut(dealt.join(hot, "bucket", "left_semi").drop("bucket").withColumn("number", F.monotonically_increasing_id()))
        spread = numbered.select("*", bucket(F.pmod(F.xxhash64(F.lit(seed + 2), "number"), F.lit(per_shard)))).drop("number")
        dealt = dealt.join(hot, "bucket", "left_anti").unionByName(spread)
        counts = counts.join(hot, "bucket", "left_anti").select("shard", "bucket", "n").unionByName(spread.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")))
        counts = counts.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))

    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    none = lambda c: F.lit(None).cast(dealt.schema[c].dataType).alias(c)
    firsts = counts.select(none("record"), none("rank"), "bucket", before.alias("first"))
    records = dealt.select("record", "rank", "bucket", F.lit(None).cast("long").alias("first"))
    # Partition b holds bucket b and nothing else, so the seed of its shuffle is always the same.
    scattered = records.unionByName(firsts).repartitionById(shards * per_shard, F.col("bucket"))
    held = scattered.groupBy("bucket").agg(F.collect_list(F.when(F.col("first").isNull(), F.struct("rank", "record"))).alias("records"), F.max("first").alias("first"))
    # Places are sorted and shuffled, as records may hold what has no order (maps).
    places = F.transform("records", lambda r, i: F.struct(r["rank"].alias("rank"), i.alias("i")))
    shuffled = F.transform(F.shuffle(F.sort_array(places), F.lit(seed)), lambda o: F.get("records", o["i"])["record"])
    return held.select("bucket", "first", F.posexplode(shuffled).alias("at", "record")).select(
        "record",
        F.floor(F.col("bucket") / F.lit(per_shard)).cast("int").alias("shard"),
        (F.col("first") + F.col("at")).cast("long").alias("slot"),
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder for each shard, the records of a bucket in one file in their slots' order.

    The folders go by ``_shard`` and the slots by ``_slot``, with as many more
    underscores before them as it takes to differ from the record's columns.
    """
    taken = {c.lower() for c in shuffled.schema["record"].dataType.names}

    def free(name):
        return free("_" + name) if name in taken else name

    shuffled.select("record.*", F.col("shard").alias(free("_shard")), F.col("slot").alias(free("_slot"))).write.partitionBy(free("_shard")).parquet(path)
