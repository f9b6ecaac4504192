"""The two trained operators: held-out accuracy, gradients, odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from tillroll.llm import quality, queries, sample, toxicity
from tillroll.llm.words import split

MEDIUM = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize(("query", "label", "divisor", "out", "least"), [(queries.op4_toxicity, "toxic", 4, 2, 0.95), (queries.op9_quality, "quality", 3, 1, 0.99)])
def test_held_out(spark, query, label, divisor, out, least):
    rows = {r["doc_id"]: r for r in query(spark, MEDIUM).collect()}
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % divisor == out) for i, r in rows.items())
    held = [i for i in labels if rows[i]["held_out"]]
    score, y = np.array([rows[i]["score"] for i in held]), np.array([labels[i] for i in held])
    assert auc(score, y) > least
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_held_out_rows_are_not_learned_from(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    texts, y, _ = sample.labelled(docs, labels, "quality", sample.remainder(F.col("doc_id"), 3) != 1)
    assert sorted(texts) == sorted(f"text {i}" for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1)
    assert all(int(t.split()[1]) % 2 == v for t, v in zip(texts, y, strict=True))
    assert len(sample.labelled(docs, labels, "quality", F.lit(True), rows=5)[0]) == 10


def test_the_sample_is_bounded(spark):
    """Repeated identifiers, long texts and contradictory labels."""
    from pyspark.sql import functions as F

    docs = spark.range(100_000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(i, "long " * 1000) for i in range(2, 30)] + [(30, None), (None, "x")], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(31)] + [(0, 1), (None, 1), (1, None), (1, 7)], "doc_id long, toxic int")
    texts, y, _ = sample.labelled(docs, labels, "toxic", F.lit(True), rows=20)
    assert len(texts) == 32 and sum(t.startswith("text") for t in texts) == 3
    texts, y, _ = sample.labelled(docs, labels, "toxic", F.lit(True), total=12_000)
    assert sum(len(t) for t, v in zip(texts, y, strict=True) if v) <= 12_000 and any(len(t) == 5000 for t in texts)
    assert all(len(t) < 100 for t in sample.labelled(docs, labels, "toxic", F.lit(True), longest=100)[0])
    assert sample.labelled(docs, labels.limit(0), "toxic", F.lit(True)) == ([], [], [])


def test_a_misspelling_shares_its_vector():
    clean = [f"the meeting number {i} was about plans and tea" for i in range(200)]
    toxic = [f"the meeting number {i} was about you worthless fools" for i in range(60)]
    model = toxicity.train(clean + toxic, [0] * 200 + [1] * 60)
    worse, better = model.scores(pa.array(["you worthles fool", "the tea was fine"]))
    assert worse > 0.5 > 0.3 > better


def test_long_texts_are_read_to_the_end():
    clean = [f"the meeting number {i} was about plans and tea" for i in range(200)]
    toxic = [f"the meeting number {i} was about you worthless fools" for i in range(60)]
    model = toxicity.train(clean + toxic, [0] * 200 + [1] * 60)
    long = "the meeting was about plans " * 5000
    a, b = model.scores(pa.array([long, long + " worthless fools"]))
    assert a < 0.3 < 0.5 < b


def test_gradients():
    rng = np.random.default_rng(0)
    texts = ["good words " * 40 + "in here", "#### bad || signs", "some more words " * 50]
    bags = quality.passages(split(pa.array(texts)))
    y, w = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    shapes = [(quality.BUCKETS, quality.WIDTH), (quality.WIDTH, quality.CODE), (quality.FEATURES, quality.CODE), (quality.CODE,)]
    shapes += [(quality.CODE, quality.GATE), (quality.CODE, quality.GATE), (quality.GATE,), (quality.CODE,), (1,)]
    model = quality.Model(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), [rng.normal(0, 0.3, s) for s in shapes])

    def loss():
        p = model.forward(bags)["p"]
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / len(y)

    for k, (param, grad) in enumerate(zip(model.params, quality.gradients(model, bags, y, w), strict=True)):
        spots = [0, param.size // 2, param.size - 1] if k else [int(bags.gram[i]) * quality.WIDTH + i % quality.WIDTH for i in (0, 5, -1)]
        for at in spots:
            kept = param.flat[at]
            param.flat[at] = kept + 1e-3
            up = loss()
            param.flat[at] = kept - 1e-3
            down = loss()
            param.flat[at] = kept
            assert np.asarray(grad).flat[at] == pytest.approx((up - down) / 2e-3, rel=2e-2, abs=1e-6)


def ngrams(word):
    """(bucket of the toxicity model) of each n-gram, one after the other."""
    raw = b"<" + word.encode() + b">"
    out = []
    for g in toxicity.GRAMS:
        for at in range(len(raw) - g + 1):
            h = 0
            for k in range(g):
                h = ((h ^ raw[at + k]) * 16777619 + k + 1) & 0xFFFFFFFF
            h = ((h ^ (h >> 15)) * 2246822519) & 0xFFFFFFFF
            out.append((h >> 16) % toxicity.BUCKETS)
    return out


TEXTS = ["The cat sat | on # the mat. " * 30, "", "x", "Fools fools WORTHLESS\tfools\n you é日本", "a " * 200 + "bb cc", None]


def test_toxicity_by_loops():
    model = toxicity.Model(np.random.default_rng(1).normal(0, 3, toxicity.BUCKETS).astype(np.float32), -0.5)

    def score(text):
        words = (text or "").lower().split() or [""]
        best = -np.inf
        for at in range(0, len(words), toxicity.RUN):
            total = 0.0
            for word in set(words[at : at + toxicity.RUN]):
                b = ngrams(word)
                total += sum(float(model.gram[i]) for i in b) / len(b) if b else 0.0
            best = max(best, total / toxicity.RUN)
        return 1 / (1 + np.exp(-(best + model.bias)))

    assert model.scores(pa.array(TEXTS)) == pytest.approx([score(t) for t in TEXTS], rel=1e-5)


def test_quality_by_loops():
    rng = np.random.default_rng(2)
    shapes = [(quality.BUCKETS, quality.WIDTH), (quality.WIDTH, quality.CODE), (quality.FEATURES, quality.CODE), (quality.CODE,)]
    shapes += [(quality.CODE, quality.GATE), (quality.CODE, quality.GATE), (quality.GATE,), (quality.CODE,), (1,)]
    model = quality.Model(rng.normal(size=quality.FEATURES), 1 + rng.random(quality.FEATURES), [rng.normal(0, 0.3, s) for s in shapes])
    table, e, w, b, v, u, g, c, d = model.params

    def shape(word):
        raw = word.encode()
        n = len(raw)
        share = lambda test: sum(map(test, raw)) / n if n else 0.0
        upper, lower, other = share(lambda x: 65 <= x <= 90), share(lambda x: 97 <= x <= 122), share(lambda x: x >= 128)
        out = [upper, lower, share(lambda x: 48 <= x <= 57), other, share(lambda x: x in b".,;:?'\"()-"), *(share(lambda x, s=s: x == ord(s)) for s in quality.SIGNS)]
        return [*out, min(n, 30) / 10, float(n > 20), float(upper > 0.5 and n > 1), float(word[-1:] in (".", "!", "?") and n > 0), float(upper + lower + other > 0.99)]

    def score(text):
        words = (text or "").split() or [""]
        runs = [words[i : i + quality.PASSAGE] for i in range(0, len(words), quality.PASSAGE)]
        codes, gates = [], []
        for run in runs:
            x = np.array([*np.mean([shape(t) for t in run], 0), len(set(run)) / len(run), sum(p == q for p, q in zip(run, run[1:], strict=False)) / len(run), len(run) / quality.PASSAGE, np.log1p(len(runs)) / 5])
            m = np.mean([np.mean([table[i % quality.BUCKETS] for i in ngrams(t)], 0) if ngrams(t) else np.zeros(quality.WIDTH) for t in run], 0)
            h = np.tanh(m @ e + (x - model.mean) / model.scale @ w + b)
            codes.append(h)
            gates.append((np.tanh(h @ v) / (1 + np.exp(-(h @ u)))) @ g)
        a = np.exp(np.array(gates) - max(gates))
        return 1 / (1 + np.exp(-((a / a.sum()) @ np.array(codes) @ c + d[0])))

    assert model.scores(pa.array(TEXTS)) == pytest.approx([score(t) for t in TEXTS], rel=1e-3)


def test_quality_learns_words():
    """Classes that differ in their words alone: no sign, case, length or repetition tells them apart."""
    rng = np.random.default_rng(3)
    good, bad, plain = ["lorem", "ipsum", "dolor", "magna"], ["zebra", "quilt", "vodka", "hyper"], [f"{a}{b}tal" for a in "bcdfg" for b in "aeiou"]
    text = lambda own: " ".join(rng.choice(plain + own, 60))
    made = [(text(good if i % 2 else bad), i % 2) for i in range(600)]
    model = quality.train(*map(list, zip(*made[:400], strict=True)))
    score, y = model.scores(pa.array([t for t, _ in made[400:]])), np.array([v for _, v in made[400:]])
    assert auc(score, y) > 0.99


@pytest.mark.parametrize("lower", [False, True])
def test_words_of_slices(lower):
    texts = ["", "  ", "Ein Wort\tÉ\n x", "a", "b B b", "日本 語"] * 5
    for column in (pa.array(texts), pa.array(texts).slice(7, 9)):
        w = split(column, lower)
        entries = [bytes(w.data[a:b]).decode() for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)]
        got = [[entries[j] for j in w.index[a:b]] for a, b in zip(w.starts[:-1], w.starts[1:], strict=True)]
        assert got == [(t.lower() if lower else t).split() or [""] for t in column.to_pylist()]


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(spark, odd, odd_rows, none, module):
    texts = ["good words here", "BAD!! ### WORTHLESS"] * 30
    model = module.train(texts, [1, 0] * 30)
    rows = module.score_documents(odd, model).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 5)}) == 1
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3, 4)}) == 1
    assert module.score_documents(none, model).count() == 0
    for labels in ([], [1, 1]):
        constant = module.train(["a", "b"][: len(labels)], labels)
        assert 0 <= constant.scores(pa.array(["x"]))[0] <= 1
    kept = toxicity.keep_rows(odd, model, lambda s: s >= 0)
    assert kept.schema == odd.schema and kept.count() == odd.count()
