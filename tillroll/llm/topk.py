"""Exact top-k search by inner product (operator 6): a Voronoi kNN join.

Pivots, a bounded deterministic sample of the vectors, split the space into
cells; each vector belongs to its nearest pivot.  A summary of a cell has its
number of vectors, its radius r around the pivot p and the least and the greatest
length of its vectors.  For a query q every score in the cell lies within
q.p - |q| r  and  q.p + |q| r, and, as 2 q.x = |q|^2 + |x|^2 - |q - x|^2 and the
distance |q - x| lies within r of |q - p|, within the bounds that follow from that.
From the lower bounds and the numbers (and from the scores of the pivots, which are
rows themselves) follows a score that the k-th best reaches at least.  A query is
sent only to cells whose upper bound reaches it, and a cell's vectors only to where
queries ask for them; each cell solves its queries locally, and the best k of the
cells' bests remain.  Nothing is approximate.

Large cells are cut into blocks of ``BLOCK_ROWS``, so a vector that a third of
all rows repeat loads no single task; many queries are cut into blocks as well.

Defined cases: vectors that are null, empty, or hold a null or non-finite
component take no part; a vector shorter than another counts as padded with
zeros; ties go to the smaller identifier; rows that repeat an identifier are
candidates of each other; a query with fewer than k candidates gets all of
them; a score beyond 64 bits is set to the nearest bound (its rank is exact).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, find_package, map_arrow

#: Most pivots; their vectors and summaries are all that the driver and the workers hold in common.
PIVOTS = 256
BLOCK_ROWS = 2048
QUERY_BLOCK = 20_000
_LONG = (1 << 63) - 1


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v array<double>, whole numbers: floor(256 x) of each component."""
    v = F.col(f"`{vector_col}`")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # floor() gives a long, which a huge component would exceed; those are whole numbers already.
    scaled = F.transform(v, lambda x: x.cast("double") * 256)
    return df.where(v.isNotNull() & (F.size(v) > 0) & whole).select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.transform(scaled, lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)).alias("v"),
    )


def matrix(column: pa.Array, width: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths])] = flat
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where they hold them, else in Python's whole numbers."""
    if q.size == 0 or x.size == 0:
        return np.zeros((len(q), len(x)))
    if float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2.0**53:
        return q @ x.T
    whole = np.vectorize(int, otypes=[object])
    return whole(q).dot(whole(x).T)


def solve(q_uid, q, x_uid, x, k: int):
    """(query row, candidate row) of each query's best k in this block; x is sorted by identifier."""
    for start in range(0, len(q), 256):
        s = products(q[start : start + 256], x)
        own = q_uid[start : start + 256, None] == x_uid[None, :]
        for i in range(len(s)):
            row = s[i]
            at = np.flatnonzero(~own[i])
            if len(at) > k and row.dtype != object:
                least = np.partition(row[at], len(at) - k)[len(at) - k]
                at = at[row[at] >= least]
            best = sorted(at, key=lambda j: -row[j])[:k] if row.dtype == object else at[np.argsort(-row[at], kind="stable")[:k]]
            for j in best:
                yield start + i, j, row[j]


@dataclass
class Routes:
    """``placed``: all vectors with their cells; ``routed``: a row for each query and each
    cell that it is sent to; ``held``: vectors of each cell; ``queries``: their number; ``width``: of a vector."""

    placed: DataFrame
    routed: DataFrame
    held: np.ndarray
    queries: int
    width: int


def routes(df: DataFrame, k: int, every: int, id_col: str, vector_col: str) -> Routes:
    find_package(df.sparkSession)
    rows = cut(usable(df, id_col, vector_col).withColumn("uid", F.monotonically_increasing_id()))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    n, width = size["n"], size["w"] or 1
    count = max(1, min(PIVOTS, math.isqrt(n) // 2))
    drawn = rows.orderBy(F.xxhash64("vec_id", "uid"), "uid").limit(2 * count).collect()
    picked = list({tuple(p["v"]): p for p in reversed(drawn)}.values())[::-1][:count]  # equal vectors make one pivot
    pivots = np.zeros((max(1, len(picked)), width))
    for i, p in enumerate(picked):
        pivots[i, : len(p["v"])] = p["v"]
    pivot_uid = np.array([p["uid"] for p in picked] or [-1])

    def assign(batches):
        for batch in batches:
            x = matrix(batch.column(1), width)
            far = np.maximum((x * x).sum(1)[:, None] - 2 * (x @ pivots.T) + (pivots * pivots).sum(1)[None, :], 0)
            cell = far.argmin(1)
            dist = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            arrays = [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(dist), pa.array(np.sqrt((x * x).sum(1)))]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "v", "uid", "cell", "dist", "norm"])

    placed = cut(map_arrow(rows, assign, "vec_id long, v array<double>, uid long, cell int, dist double, norm double"))
    cells = len(pivots)
    held, radius, short, long = np.zeros(cells, dtype=np.int64), np.zeros(cells), np.zeros(cells), np.zeros(cells)
    for c, m, r, least, most in placed.groupBy("cell").agg(F.count(F.lit(1)), F.max("dist"), F.min("norm"), F.max("norm")).collect():  # a row for each pivot
        held[c], radius[c], short[c], long[c] = m, r * (1 + 1e-9) + 1e-6, least, most

    def route(batches):
        for batch in batches:
            q = matrix(batch.column(1), width)
            uid, own = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            if not len(q):
                continue
            near = q @ pivots.T
            square = (q * q).sum(1)[:, None]
            reach = np.sqrt(square) * radius[None, :]
            away = np.sqrt(np.maximum(square - 2 * near + (pivots * pivots).sum(1)[None, :], 0))
            low = np.maximum(near - reach, (square + short**2 - (away + radius) ** 2) / 2)
            high = np.minimum(near + reach, (square + long**2 - np.maximum(away - radius, 0) ** 2) / 2)
            slack = 1e-9 * (square + (away + radius) ** 2 + long**2 + np.abs(near) + reach) + 1e-6
            low, high = low - slack, high + slack
            low[:, held == 0], high[:, held == 0] = -np.inf, -np.inf
            order = np.argsort(-low, axis=1)
            there = np.broadcast_to(held, low.shape).copy()
            there[np.arange(len(q)), own] -= 1
            enough = np.cumsum(np.take_along_axis(there, order, 1), axis=1) >= k
            at = np.where(enough.any(1), enough.argmax(1), cells - 1)
            least = np.where(enough.any(1), low[np.arange(len(q)), order[np.arange(len(q)), at]], -np.inf)
            if cells > k:  # the pivots are rows, too
                seen = np.where(uid[:, None] == pivot_uid[None, :], -np.inf, near - slack)
                least = np.maximum(least, np.partition(seen, cells - k, axis=1)[:, cells - k])
            to_query, to_cell = np.nonzero((high >= least[:, None]) & (held > 0)[None, :])
            taken = batch.take(pa.array(to_query))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), taken.column(2), pa.array(to_cell.astype(np.int32))], ["vec_id", "v", "uid", "cell"])

    routed = map_arrow(placed.where(F.col("vec_id") % every == 0), route, "vec_id long, v array<double>, uid long, cell int")
    return Routes(placed, routed, held, size["q"], width)


def top_k(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank int, vec_id, score long: the best k of all rows for each row
    whose identifier is divisible by ``every``."""
    r = routes(df, k, every, id_col, vector_col)
    placed, routed, width = r.placed, r.routed, r.width
    many = F.array(*[F.lit(max(1, -(-int(m) // BLOCK_ROWS))) for m in r.held])
    query_blocks = max(1, -(-r.queries // QUERY_BLOCK))
    asked = routed.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(query_blocks))).withColumn("block", F.explode(F.sequence(F.lit(0), F.element_at(many, F.col("cell") + 1) - 1)))
    asked = cut(asked)
    wanted = asked.select(*(F.col(c).alias(c) for c in ("cell", "block", "part"))).distinct()
    given = placed.drop("dist", "norm").withColumn("block", F.pmod(F.xxhash64("uid"), F.element_at(many, F.col("cell") + 1)).cast("int")).join(wanted, ["cell", "block"])

    def local(queries: pa.Table, data: pa.Table) -> pa.Table:
        names = ["query_uid", "query_id", "vec_id", "uid", "score"]
        kinds = [pa.int64()] * 4 + [pa.string()]
        if not queries.num_rows or not data.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        data = data.sort_by([("vec_id", "ascending"), ("uid", "ascending")])
        q, x = (matrix(t["v"].combine_chunks() if t["v"].num_chunks != 1 else t["v"].chunk(0), width) for t in (queries, data))
        q_uid, x_uid = queries["uid"].to_numpy(), data["uid"].to_numpy()
        found = list(solve(q_uid, q, x_uid, x, k))
        a = np.array([f[0] for f in found], dtype=np.int64)
        b = np.array([f[1] for f in found], dtype=np.int64)
        return pa.table([pa.array(q_uid[a]), queries["vec_id"].take(pa.array(a)), data["vec_id"].take(pa.array(b)), pa.array(x_uid[b]), pa.array([str(int(f[2])) for f in found], pa.string())], names=names)

    keys = ["cell", "block", "part"]
    best = asked.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInArrow(local, "query_uid long, query_id long, vec_id long, uid long, score string")
    value = F.col("score").cast("decimal(38,0)")
    ranked = best.withColumn("value", value).withColumn("rank", F.row_number().over(Window.partitionBy("query_uid").orderBy(F.desc("value"), "vec_id", "uid")))
    bounded = F.greatest(F.least(F.col("value"), F.lit(_LONG).cast("decimal(38,0)")), F.lit(-_LONG - 1).cast("decimal(38,0)"))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", bounded.cast("long").alias("score"))
