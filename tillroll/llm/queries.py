"""The queries of this folder's operators, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, changes, chat, fingerprints, html_text, minhash, packing, quality, sample, sharding, token_counts, topk, toxicity
from .common import table

SHARDS = 24


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 24 shards; the digests come from the shuffled records."""
    docs = table(spark, sf_dir, "documents")
    text = F.col("record.text")
    size = lambda t: F.coalesce(F.octet_length(t), F.lit(0)) + 8
    shuffled = sharding.shuffle_into_shards(docs, "doc_id", SHARDS, size(F.col("text")))
    return shuffled.select(
        F.col("record.doc_id").alias("doc_id"),
        size(text).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        sharding.grown_shard_of(F.col("record.doc_id"), F.col("shard"), SHARDS).alias("grown_shard"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=2048)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every line of every document; one that crosses goes by its first character."""
    return token_counts.count_line_tokens(table(spark, sf_dir, "documents"), rule="first")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, scored by a model that hasn't seen the rows held out (crc32 mod 4 = 2)."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (sample.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents by 2-word shingles."""
    return minhash.group(table(spark, sf_dir, "documents"), words=2)


OP8_SQL = r"""
with recursive
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] end) as s from w),
n as (select doc_id, len(s) as n from s),
e as (select doc_id, hash(unnest(s)) as h from s),
c as (select a.doc_id as u, b.doc_id as v, count(*) as c from e a join e b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
l as (select u, v from c join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 80 * (x.n + y.n - c)),
b as (select u, v from l union all select v, u from l),
r(doc_id, other) as (select doc_id, doc_id from n union select r.doc_id, b.v from r join b on b.u = r.other),
m as (select doc_id, min(other) as component_id from r group by 1)
select n.doc_id, cast(n.n as bigint) as n_shingles, m.component_id, n.doc_id = m.component_id as kept from n join m using (doc_id)
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, scored by a model that hasn't seen the rows held out (crc32 mod 3 = 1)."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (sample.remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for every 50th."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


OP6_SQL = """
with v as (
  select vec_id, [floor(256 * cast(x as double)) for x in embedding] as v from embeddings
  where embedding is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents")).drop("same")


CONFLICT = "\\### Assistant: </turn> ok"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, whose texts look like the template."""
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONFLICT).alias("text")
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(rows))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document by two tokenizers, aligned."""
    return alignment.link_statistics(table(spark, sf_dir, "documents"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    texts = html_text.extract(table(spark, sf_dir, "pages"), keep=("url",))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


CHANGE_BATCHES = 10


def op13_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All client changes in ten batches by day; the digests come from the applier's rows."""
    rows = changes.with_numbers(table(spark, sf_dir, "client_changes").distinct(), "client_id", "seq")
    h = F.crc32(F.coalesce(F.col("change_id").cast("string"), F.lit("")).cast("binary"))
    day = F.unix_date(F.col("valid_at").cast("date")) + (5 * (h % 4)).cast("int")
    kept = rows.where(F.col("valid_at").isNotNull() & (h % 11 != 0)).withColumn("day", day)
    number = F.greatest(F.lit(1), F.least(F.lit(CHANGE_BATCHES), 1 + F.floor((F.col("day") - 19723) * CHANGE_BATCHES / 160)))
    applied = changes.apply_changes(kept.withColumn("batch", number.cast("int")), CHANGE_BATCHES)
    return changes.latest_applied(applied).select(
        F.col("id").alias("change_id"),
        F.when(~F.col("no_client"), F.col("client")).alias("client_id"),
        "status",
        "batch",
        "missed",
        "city",
        F.floor(100 * F.col("balance") + 0.5).alias("cents"),
        "current",
    )


QUERIES = {f.__name__: f for f in (op1_sharding, op2_packing, op3_token_counts, op4_toxicity, op5_fingerprints, op6_topk, op7_bpe, op8_minhash, op9_quality, op10_chat, op11_alignment, op12_html_text, op13_changes)}

SQL: dict[str, str] = {"op6_topk": OP6_SQL, "op8_minhash": OP8_SQL}
