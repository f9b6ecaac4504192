"""Quality (operator 9): attention-based multiple-instance learning in numpy.

A document is a bag of passages of ``PASSAGE`` words.  A passage is encoded from
its subwords: a word's vector is the average of the learned vectors of its
character n-grams (hashed into ``BUCKETS``), a passage's the average of its words'.
Beside that vector m stand a few shares x of signs, cases and repeated words,
which averages of words can't show.  A gated attention, learned from the
documents' labels alone, weighs the passages, and the weighted sum of their codes
gives the score:

    h = tanh(m W' + x W + b)      a = softmax(tanh(h V) * sigmoid(h U) . w)
    score = sigmoid(sum(a h) . c + d)

Everything is trained jointly, the n-grams' vectors too, by Adam on a bounded
sample of labelled rows, until the steps are done or the loss is.

Defined cases: a null or empty text has one passage with the empty word; with
labels of one class only (or none) there is nothing to learn and every score is
0.5; repeated rows get equal scores; every passage of every text is read; labels,
lang, source and doc_id are no inputs; extra columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sample
from .common import map_arrow, release, size_chunks, text_column
from .toxicity import entry_chunks, grams
from .words import Words, spans, split

PASSAGE = 64
CODE, GATE = 16, 8
#: Hashed n-grams of 3 to 5 bytes, and the length of their vectors.
BUCKETS, WIDTH = 1 << 14, 8
#: Passes over the sample at least, and steps at least.
EPOCHS, STEPS, BATCH, RATE = 12, 300, 256, 0.01
#: An epoch with a smaller mean loss is the last: there is next to no gradient left.
DONE = 0.002
SEED = 9
THRESHOLD = 0.5
#: Signs counted one by one; fixed values.
SIGNS = "|!#$%&*<>{}=/\\_@"
WORD_FEATURES = 10 + len(SIGNS)
FEATURES = WORD_FEATURES + 4


def word_features(words: Words) -> np.ndarray:
    """What each dictionary entry looks like: (entries, WORD_FEATURES)."""
    n = words.lengths
    d = words.data
    classes = [
        (d >= 65) & (d <= 90),
        (d >= 97) & (d <= 122),
        (d >= 48) & (d <= 57),
        d >= 128,
        np.isin(d, np.frombuffer(b".,;:?'\"()-", dtype=np.uint8)),
        *(d == ord(s) for s in SIGNS),
    ]
    out = np.zeros((len(n), WORD_FEATURES), dtype=np.float32)
    full = np.flatnonzero(n > 0)
    begin = words.offsets[:-1][full]
    share = np.zeros((len(n), len(classes)), dtype=np.float32)
    for i, c in enumerate(classes):
        if len(full):
            share[full, i] = np.add.reduceat(c.astype(np.int64), begin) / n[full]
    out[:, : len(classes)] = share
    k = len(classes)
    out[:, k] = np.minimum(n, 30) / 10
    out[:, k + 1] = n > 20
    out[:, k + 2] = (share[:, 0] > 0.5) & (n > 1)
    if len(full):
        last = d[words.offsets[1:][full] - 1]
        out[full, k + 3] = np.isin(last, np.frombuffer(b".!?", dtype=np.uint8))
    out[:, k + 4] = (share[:, 0] + share[:, 1] + share[:, 3]) > 0.99
    return out


@dataclass
class Bags:
    """Passages: shares ``x``, their words ``index`` from ``runs[i]`` to ``runs[i + 1]``; ``first``
    is the first passage of each document (and their number).  Dictionary entry j has
    the n-grams from ``gram_at[j]`` to ``gram_at[j + 1]`` of ``gram``."""

    x: np.ndarray
    index: np.ndarray
    runs: np.ndarray
    first: np.ndarray
    gram: np.ndarray
    gram_at: np.ndarray

    def take(self, docs: np.ndarray) -> Bags:
        """The passages of some documents; the dictionary holds their words only."""
        rows, first = _ranges(self.first[:-1][docs], np.diff(self.first)[docs])
        at, runs = _ranges(self.runs[:-1][rows], np.diff(self.runs)[rows])
        entries, index = np.unique(self.index[at], return_inverse=True)
        of, gram_at = _ranges(self.gram_at[:-1][entries], np.diff(self.gram_at)[entries])
        return Bags(self.x[rows], index, runs, first, self.gram[of].astype(np.intp), gram_at)

    def means(self, table: np.ndarray) -> np.ndarray:
        """The vector of each passage, one coordinate after the other."""
        sizes = np.diff(self.gram_at)
        full = np.flatnonzero(sizes)
        begin, held, words = self.gram_at[:-1][full], sizes[full], np.diff(self.runs)
        out = np.empty((len(self.x), table.shape[1]))
        for k, column in enumerate(np.ascontiguousarray(table.T)):
            entries = np.zeros(len(sizes), dtype=column.dtype)
            if len(full):
                entries[full] = np.add.reduceat(column.take(self.gram), begin) / held
            out[:, k] = np.add.reduceat(entries.take(self.index), self.runs[:-1]) / words
        return out

    def spread(self, of_passage: np.ndarray, buckets: int) -> np.ndarray:
        """The gradient of the n-grams' vectors from that of the passages' vectors."""
        words, sizes = np.diff(self.runs), np.diff(self.gram_at)
        held = np.maximum(sizes, 1)
        out = np.empty((buckets, of_passage.shape[1]))
        for k in range(out.shape[1]):
            of_entry = np.bincount(self.index, weights=np.repeat(of_passage[:, k] / words, words), minlength=len(sizes)) / held
            out[:, k] = np.bincount(self.gram, weights=np.repeat(of_entry, sizes), minlength=buckets)
        return out


def _ranges(begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of several ranges one after the other, and where each range begins there."""
    first = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(begin - first[:-1], n) + np.arange(first[-1]), first


def word_grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    held, parts = [np.zeros(1, dtype=np.int64)], []
    for low, high in entry_chunks(words):
        e, b = grams(words, low, high)
        held.append(np.bincount(e, minlength=high - low))
        parts.append(b[np.argsort(e, kind="stable")] % BUCKETS)
    return np.concatenate(parts), np.cumsum(np.concatenate(held))


def passages(words: Words) -> Bags:
    runs, first = spans(words.starts, PASSAGE)
    total = len(words.index)
    sizes = np.diff(np.append(runs, total))
    which = np.repeat(np.arange(len(runs)), sizes)
    per_word = word_features(words)
    x = np.empty((len(runs), FEATURES), dtype=np.float32)
    for j in range(WORD_FEATURES):
        x[:, j] = np.add.reduceat(per_word[:, j][words.index], runs) / sizes
    entries = int(words.index.max()) + 1
    pairs = np.unique(which * np.int64(entries) + words.index)
    k = WORD_FEATURES
    x[:, k] = np.bincount(pairs // entries, minlength=len(runs)) / sizes
    same = np.concatenate([[False], words.index[1:] == words.index[:-1]])
    same[runs] = False
    x[:, k + 1] = np.add.reduceat(same.astype(np.int64), runs) / sizes
    x[:, k + 2] = np.minimum(sizes, PASSAGE) / PASSAGE
    x[:, k + 3] = np.log1p(np.diff(first))[np.repeat(np.arange(len(first) - 1), np.diff(first))] / 5
    return Bags(x, words.index, np.append(runs, total), first, *word_grams(words))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    params: list[np.ndarray]
    constant: float | None = None

    def forward(self, bags: Bags) -> dict[str, np.ndarray]:
        table, e, w, b, v, u, g, c, d = self.params
        first = bags.first
        which = np.repeat(np.arange(len(first) - 1), np.diff(first))
        x, m = (bags.x - self.mean) / self.scale, bags.means(table)
        h = np.tanh(m @ e + x @ w + b)
        t, s = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        z = (t * s) @ g
        a = np.exp(z - np.maximum.reduceat(z, first[:-1])[which])
        a /= np.add.reduceat(a, first[:-1])[which]
        z = np.add.reduceat(a[:, None] * h, first[:-1])
        return {"x": x, "m": m, "h": h, "t": t, "s": s, "a": a, "z": z, "which": which, "p": 1 / (1 + np.exp(-np.clip(z @ c + d[0], -30, 30)))}

    def scores(self, column: pa.Array) -> np.ndarray:
        if not len(column):
            return np.zeros(0)
        if self.constant is not None:
            return np.full(len(column), self.constant)
        return self.forward(passages(split(column)))["p"].astype(np.float64)


def gradients(model: Model, bags: Bags, y: np.ndarray, weight: np.ndarray, f: dict[str, np.ndarray] | None = None) -> list[np.ndarray]:
    table, e, w, b, v, u, g, c, d = model.params
    f, first = f or model.forward(bags), bags.first
    h, t, s, a, which = f["h"], f["t"], f["s"], f["a"], f["which"]
    dl = (f["p"] - y) * weight / len(y)
    dz = dl[:, None] * c[None, :]
    da = (dz[which] * h).sum(1)
    de = a * (da - np.add.reduceat(a * da, first[:-1])[which])
    dts = de[:, None] * g[None, :]
    dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
    dh = a[:, None] * dz[which] + dt @ v.T + ds @ u.T
    dx = dh * (1 - h * h)
    return [bags.spread(dx @ e.T, len(table)), f["m"].T @ dx, f["x"].T @ dx, dx.sum(0), h.T @ dt, h.T @ ds, (t * s).T @ de, f["z"].T @ dl, np.array([dl.sum()])]


def train(texts: list[str], labels: list[int], weights: list[float] | None = None, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    y = np.array(labels, dtype=np.float64)
    weight = np.ones(len(y)) if weights is None else np.array(weights)
    if len(set(labels)) < 2:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), [], 0.5)
    bags = passages(split(pa.array(texts, pa.string())))
    rng = np.random.default_rng(seed)
    init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    params = [table, init(WIDTH, CODE), init(FEATURES, CODE), np.zeros(CODE), init(CODE, GATE), init(CODE, GATE), init(GATE), init(CODE), np.zeros(1)]
    model = Model(bags.x.mean(0), bags.x.std(0) + 0.05, params)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step, epochs = 0, max(epochs, -(-STEPS // -(-len(y) // BATCH)))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate, loss = RATE * (1 - epoch / epochs) + RATE / 20, 0.0
        for at in range(0, len(order), BATCH):
            step += 1
            docs = np.sort(order[at : at + BATCH])
            part = bags.take(docs)
            f = model.forward(part)
            right = np.where(y[docs] == 1, f["p"], 1 - f["p"])
            loss -= (weight[docs] * np.log(right)).sum()
            for p, grad, (m1, m2) in zip(params, gradients(model, part, y[docs], weight[docs], f), state, strict=True):
                m1 *= 0.9
                m1 += 0.1 * grad
                m2 *= 0.99
                m2 += 0.01 * grad * grad
                p -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8) + rate * 1e-4 * p
        if loss < DONE * weight.sum():
            break
    params[0] = table.astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = sample.ROWS_OF_CLASS) -> Model:
    """Learn from rows whose crc32(doc_id) mod 3 isn't 1, ``rows`` of each class at most."""
    model = train(*sample.labelled(docs, labels, "quality", sample.remainder(F.col("doc_id"), 3) != 1, rows))
    release()
    return model


def score_documents(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score double: the model (of a fixed size) over every passage of every text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in size_chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(part.column(1)))], ["doc_id", "score"])

    return map_arrow(text_column(df, id_col, text_col), run, "doc_id long, score double")
