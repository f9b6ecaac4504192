import math
import random

import pytest
from helpers import oracle, same_rows
from tillroll.llm import queries, topk


def brute(rows, k, every):
    whole = []
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for a, (i, q) in enumerate(whole):
        if i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), j) for b, (j, v) in enumerate(whole) if a != b)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def found(df, k, every):
    return sorted(tuple(r) for r in topk.top_k(df, k, every).collect())


@pytest.mark.parametrize("block", [5, 2048])
def test_clusters_ties_and_copies(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 20)
    rng = random.Random(block)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = [(i, [float(c + rng.gauss(0, 0.02)) for c in centres[i % 8]]) for i in range(240)]
    rows += [(240 + i, rows[0][1]) for i in range(60)]  # one vector many times
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, 5, 7) == brute(rows, 5, 7)


def test_clusters_are_pruned(spark):
    """Clustered vectors: a query goes to few of the cells, and the result is still exact."""
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(16)]
    rows = [(i, [float(c + rng.gauss(0, 0.01)) for c in centres[i % 16]]) for i in range(6400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    r = topk.routes(df, 5, 50, "vec_id", "embedding")
    sent = r.routed.select("uid", "cell").distinct().count()
    assert r.queries == 128 and len(r.held) == 40
    assert sent < 0.3 * r.queries * len(r.held)
    assert found(df.where("vec_id < 1600"), 5, 50) == brute(rows[:1600], 5, 50)


def test_odd_vectors(spark):
    rows = [
        (0, [0.5, -0.25]), (1, None), (2, []), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
        (50, [0.001, -0.001]), (50, [0.001, -0.001]), (7, [1.0]), (8, [1e17, -1e17]), (100, [3e5, 2e5]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as uid", "2 as cell")
    bounded = [(q, r, j, max(-(1 << 63), min((1 << 63) - 1, s))) for q, r, j, s in brute(rows, 5, 50)]
    assert found(df, 5, 50) == sorted(bounded)
    assert found(df.where("1 = 0"), 5, 50) == []
    assert found(df.where("vec_id = 0"), 5, 50) == []


def test_query(spark, small):
    same_rows(queries.op6_topk(spark, small), oracle(small).sql(queries.SQL["op6_topk"]))
