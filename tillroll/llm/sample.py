"""Labelled rows to learn from: a bounded sample, the same at every run.

Defined cases: a null identifier or a label other than 0 and 1 is not learned from;
an identifier with both labels counts once for each; of documents that repeat an
identifier the one whose text has the smallest hash is learned from; a null text
counts as empty; without labels the sample is empty.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, temporary

#: Most rows of each class.
ROWS_OF_CLASS = 3000
#: Most bytes of a class's texts together, and of one text (longer ones are not learned from).
BYTES_OF_CLASS = 6 << 20
BYTES_OF_TEXT = 1 << 19


def remainder(id_col: Column, divisor: int) -> Column:
    """crc32 of the identifier as text, modulo ``divisor``; a null identifier counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(divisor)).cast("int")


def labelled(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    learn: Column,
    rows: int = ROWS_OF_CLASS,
    total: int = BYTES_OF_CLASS,
    longest: int = BYTES_OF_TEXT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[list[str], list[int], list[float]]:
    """Texts, labels and weights of at most ``rows`` rows and ``total`` bytes of each class.

    ``learn`` says of a ``doc_id`` whether it may be learned from.  A class's rows
    are those with the smallest hashes, as many as the bytes allow.  The weights
    give the classes the shares that they have among all labelled rows.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & learn).select("doc_id", F.col(label_col).cast("int").alias("y")).distinct()
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64(F.lit(7), "doc_id"), F.col("doc_id")]
    picked = [known.where(F.col("y") == y).orderBy(*order).limit(rows) for y in (0, 1)]
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # 2 * rows identifiers at most, so they can be sent to all tasks; repeated ones are aggregated before the exchange.
    found = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").where(F.octet_length("text") <= longest)
    once = found.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    with temporary(docs.sparkSession):
        held = cut(once.withColumn("order", order[0]).withColumn("bytes", F.octet_length("text").cast("long")))
        # Lengths decide how far a class's texts go; then only these texts are gathered.
        last: dict[int, tuple[int, int]] = {}
        used = {0: 0, 1: 0}
        for r in sorted(held.select("y", "order", "doc_id", "bytes").collect()):
            used[r["y"]] += r["bytes"]
            if used[r["y"]] <= total:
                last[r["y"]] = (r["order"], r["doc_id"])
        upto = [(F.col("y") == y) & (F.struct("order", "doc_id") <= F.struct(F.lit(o).cast("long").alias("order"), F.lit(i).cast("long").alias("doc_id"))) for y, (o, i) in last.items()]
        near = reduce(or_, upto, F.lit(False))
        taken = sorted(held.where(near).select("text", "y", "doc_id").collect(), key=lambda r: (r["doc_id"], r["y"]))
    every = sum(counts.values()) or 1
    have = {y: sum(r["y"] == y for r in taken) for y in (0, 1)}
    weight = {y: counts.get(y, 0) / every / max(1, have[y]) * len(taken) for y in (0, 1)}
    return [r["text"] for r in taken], [r["y"] for r in taken], [weight[r["y"]] for r in taken]
