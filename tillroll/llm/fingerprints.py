"""Document fingerprints (operator 5): Lempel-Ziv phrases under minimum hashes.

A document's UTF-8 bytes are parsed into dictionary phrases: each phrase is the
longest known one plus one byte, and is then known itself.  Texts that share
long stretches share phrases, as they would compress well together.  The
fingerprint is the ``SIZE`` smallest hashes of the set of phrases, and the
likeness of two is the share of common hashes among the ``SIZE`` smallest of
both together, an estimate of the Jaccard index of the phrase sets (exact for
small ones).

Defined cases: a null text counts as empty; the fingerprint of an empty text is
empty, like another empty one (1.0) and unlike all others (0.0); equal texts
have equal fingerprints; a table of one row is its own next document; rows go
by identifier (null first), equal ones by text; extra columns play no part;
texts of any length are parsed whole.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, size_chunks

#: Hashes in a fingerprint.
SIZE = 128
#: Rows that one task puts in order.
BUCKET_ROWS = 1000
#: Most buckets; beyond them, buckets have more rows (tasks read them as streams).
BUCKETS = 50_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Powers:
    """Powers of the polynomial hash's base and of its inverse, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            powers = []
            for base in (_BASE, _INVERSE):
                p = np.full(size, base, dtype=np.uint64)
                p[0] = 1
                powers.append(np.multiply.accumulate(p))
            self.up, self.down = powers
        return self.up[:n], self.down[:n]


POWERS = Powers()


def parse(data: bytes, known: dict[int, int], at: int, node: int, ends: list[int], keys: list[int]) -> int:
    """Go on parsing at byte ``at`` from ``node`` of the phrase tree; the node where the data ends.

    ``known`` maps a node and a byte to the node of the longer phrase; nodes
    are multiples of 256.  Appends where phrases end, and what was learned.
    """
    get, ended, learned = known.get, ends.append, keys.append
    fresh = len(known) << 8
    for at, c in enumerate(data, at + 1):  # noqa: B020
        key = node + c
        node = get(key)
        if node is None:
            fresh += 256
            known[key] = fresh
            learned(key)
            ended(at)
            node = 0
    return node


def sketch(data: bytes, ends: list[int]) -> np.ndarray:
    """The smallest hashes of the phrases of ``data`` that end at ``ends`` (and of the last, unfinished one)."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.uint32)
    to = np.array(ends if ends and ends[-1] == n else [*ends, n], dtype=np.int64)
    start = np.concatenate([[0], to[:-1]])
    up, down = POWERS.to(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[to] - total[start]) * down[start]
    h ^= h >> np.uint64(31)  # spread the polynomial's value over all bits
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h = (h >> np.uint64(32)).astype(np.uint32)
    return np.unique(h)[:SIZE]


def fingerprint(text: str) -> np.ndarray:
    data, ends = text.encode(), []
    parse(data, {}, 0, 0, ends, [])
    return sketch(data, ends)


def text_of(sketch_: np.ndarray) -> str:
    return base64.b64encode(sketch_.astype("<u4").tobytes()).decode()


def sketch_of(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype="<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[:-1] == both[1:]
    # Number of different values up to each one; only the SIZE smallest count.
    rank = np.cumsum(np.concatenate([[True], ~twice]))
    most = min(SIZE, int(rank[-1]))
    return float(twice[rank[:-1] <= most].sum()) / most


def edit(text: str, following: str) -> tuple[int, str]:
    """Code points that stay, and the text whose last quarter comes from ``following``."""
    q = len(text) // 4
    return len(text) - q, text[: len(text) - q] + following[:q]


def compare(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Fingerprints of a text and of its edited form.  The part they share is parsed once."""
    stay, edited = edit(text, following)
    data, other = text.encode(), edited.encode()
    shared = len(text[:stay].encode())
    known, ends, keys = {}, [], []
    node = parse(data[:shared], known, 0, 0, ends, keys)
    kept = list(ends)
    learned: list[int] = []
    parse(data[shared:], known, shared, node, ends, learned)
    for key in learned:  # back to the state at the edit
        del known[key]
    parse(other[shared:], known, shared, node, kept, keys)
    return sketch(data, ends), sketch(other, kept), edited


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt into ranges of the identifier and sorted, each range followed by the first row of the next.

    bucket int, guest boolean, k long (the identifier, null lowest), doc_id, text.
    The ranges' bounds are quantiles, the guests are picked by their
    identifiers (one for each range), so texts go through one exchange.
    """
    from pyspark.ml.feature import Bucketizer

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("kd", F.col("k").cast("double"))
    n = rows.count()
    buckets = max(1, min(BUCKETS, n // BUCKET_ROWS))
    inner = rows.agg(F.percentile_approx("kd", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0] if buckets > 1 else []
    splits = [float("-inf"), *sorted({x for x in inner or [] if x > -(2.0**63)}), float("inf")]
    if len(splits) == 2:
        bucketed = rows.withColumn("bucket", F.lit(0))
    else:
        bucketed = Bucketizer(splits=splits, inputCol="kd", outputCol="bucket").transform(rows).withColumn("bucket", F.col("bucket").cast("int"))
    firsts = sorted(bucketed.groupBy("bucket").agg(F.min("k").alias("k")).collect())  # a row for each bucket
    places = [b for b, _ in firsts]
    spark = df.sparkSession
    guests = spark.createDataFrame([(k, places[i - 1]) for i, (_, k) in enumerate(firsts)], "k long, host int")
    # As many rows as there are buckets: at most BUCKETS.
    dealt = bucketed.join(F.broadcast(guests), "k", "left").select(
        F.explode(F.array_compact(F.array(F.struct(F.col("bucket"), F.lit(False).alias("guest")), F.when(F.col("host").isNotNull(), F.struct(F.col("host").alias("bucket"), F.lit(True).alias("guest")))))).alias("to"), "k", "doc_id", "text"
    )
    return dealt.select("to.bucket", "to.guest", "k", "doc_id", "text").repartitionById(len(splits) - 1, F.col("bucket")).sortWithinPartitions("bucket", "guest", "k", "text")


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars long, edited_sha256, fingerprint, edited_fingerprint string, near_edited, near_next double."""

    def run(batches):
        held = None  # bucket, doc_id and text of the last row that isn't a guest
        waiting = None  # what is known of the row before it
        rows: list[tuple] = []

        def flush():
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            rows.clear()
            return out

        def finish(sketch_):
            doc_id, n, digest, own, edited = waiting
            rows.append((doc_id, n, digest, text_of(own), text_of(edited), likeness(own, edited), likeness(own, sketch_)))

        for part in size_chunks(batches, "text"):
            for bucket, guest, doc_id, text in zip(*(part.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if held is not None and held[0] == bucket:
                    own, edited, other = compare(held[2], text)
                    if waiting is not None:
                        finish(own)
                    waiting = (held[1], len(held[2]), hashlib.sha256(other.encode()).hexdigest(), own, edited)
                    if guest:
                        finish(fingerprint(text))
                        waiting = None
                held = None if guest else (bucket, doc_id, text)
                if len(rows) >= 1000:
                    yield flush()
        if rows:
            yield flush()

    return map_arrow(with_next(df, id_col, text_col), run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
