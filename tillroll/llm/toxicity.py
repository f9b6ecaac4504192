"""Toxicity (operator 4): subword bags under a linear softmax, trained in numpy.

A word's vector is the average of the vectors of its character n-grams (its
UTF-8 bytes between boundary marks, in hashed buckets), so a misspelling that
was never seen shares most of its vector with the word it stands for.  A
document is read in runs of ``RUN`` words; the average over a run goes into a
linear softmax, and the document's score is that of its most toxic run.
Embeddings and softmax are trained jointly, on a bounded sample of labelled
rows, by Adam on the documents' cross-entropy; while training, the runs of a
document share its gradient by a softmax over their logits.

As the softmax is linear, a run's logit is the average of one number for each
n-gram.  Scoring uses that: the model that travels to the tasks is a vector of
``BUCKETS`` numbers.

Defined cases: a null or empty text has one empty run and gets the score that
the bias gives; without labelled rows of both classes every score is the share
of toxic rows (0 if there are none); repeated rows get equal scores; whole
texts are read; labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import sample
from .common import map_arrow, release, size_chunks, text_column
from .words import Words, spans, split

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
WIDTH = 8
RUN = 2
#: Passes over the sample at least, and steps at least.
EPOCHS, STEPS, BATCH = 6, 50, 256
RATE = 0.03
SEED = 5
THRESHOLD = 0.3


def grams(words: Words, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(dictionary entry, bucket) of every n-gram of the entries from ``low`` to ``high``."""
    n = words.lengths[low:high]
    count = high - low
    size = int(n.sum()) + 2 * count
    begin = words.offsets[low:high] - words.offsets[low] + 2 * np.arange(count)
    letters = np.full(size, ord(">"), dtype=np.uint32)
    letters[begin] = ord("<")
    entry = np.repeat(np.arange(count, dtype=np.int32), n + 2)
    at = np.arange(size) - begin[entry]
    letters[(at > 0) & (at <= n[entry])] = words.data[words.offsets[low] : words.offsets[high]]
    room = (n + 2)[entry] - at
    entries, buckets = [], []
    h = np.zeros(size, dtype=np.uint32)
    for g in range(1, max(GRAMS) + 1):
        step = np.zeros(size, dtype=np.uint32)
        step[: max(0, size - g + 1)] = letters[g - 1 :]
        h = (h ^ step) * np.uint32(16777619) + np.uint32(g)
        if g in GRAMS:
            fits = room >= g
            x = h[fits]
            x = (x ^ (x >> np.uint32(15))) * np.uint32(2246822519)
            entries.append(entry[fits])
            buckets.append(((x >> np.uint32(16)) % np.uint32(BUCKETS)).astype(np.int32))
    return np.concatenate(entries), np.concatenate(buckets)


#: Dictionary entries whose n-grams are held at once.
ENTRIES = 40_000


def entry_chunks(words: Words):
    count = len(words.lengths)
    for low in range(0, count, ENTRIES):
        yield low, min(low + ENTRIES, count)


def once(index: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """1 for the first place of a word in its run, 0 where it is repeated there."""
    which = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, len(index))))
    key = which * np.int64(int(index.max()) + 1 if len(index) else 1) + index
    order = np.argsort(key, kind="stable")
    out = np.ones(len(index), dtype=np.float32)
    out[order[1:]] = key[order[1:]] != key[order[:-1]]
    return out


@dataclass
class Model:
    """A number for each bucket, the bias, and how it was measured."""

    gram: np.ndarray
    bias: float

    def logits(self, words: Words) -> np.ndarray:
        """The logit of each document."""
        value = np.zeros(len(words.lengths))
        for low, high in entry_chunks(words):
            e, b = grams(words, low, high)
            held = np.bincount(e, minlength=high - low)
            value[low:high] = np.bincount(e, weights=self.gram[b], minlength=high - low) / np.maximum(held, 1)
        runs, first = spans(words.starts, RUN)
        sums = np.add.reduceat(value[words.index] * once(words.index, runs), runs) / RUN
        return np.maximum.reduceat(sums, first[:-1]) + self.bias

    def scores(self, column: pa.Array) -> np.ndarray:
        if not len(column):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.logits(split(column, lower=True)), -30, 30)))


def train(texts: list[str], labels: list[int], weights: list[float] | None = None, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    y = np.array(labels, dtype=np.float64)
    w = np.ones(len(y)) if weights is None else np.array(weights)
    if len(set(labels)) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-9, 1 - 1e-9))
        return Model(np.zeros(BUCKETS, dtype=np.float32), float(np.log(share / (1 - share))))
    words = split(pa.array(texts, pa.string()), lower=True)
    held, parts = [], []
    for low, high in entry_chunks(words):
        e, b = grams(words, low, high)
        held.append(np.bincount(e, minlength=high - low))
        parts.append(b[np.argsort(e, kind="stable")])
    b, gram_at = np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(held))])
    del parts, held
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    softmax = np.stack([-np.ones(WIDTH), np.ones(WIDTH)], 1).astype(np.float32) + rng.normal(0, 0.1, (WIDTH, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, softmax, bias)]
    scale, step = np.float32(8.0), 0
    for _ in range(max(epochs, -(-STEPS // -(-len(y) // BATCH)))):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            step += 1
            docs = np.sort(order[at : at + BATCH])
            n = words.starts[docs + 1] - words.starts[docs]
            starts = np.concatenate([[0], np.cumsum(n)])
            chosen = np.repeat(words.starts[docs] - starts[:-1], n) + np.arange(starts[-1])
            entries, inverse = np.unique(words.index[chosen], return_inverse=True)
            m = gram_at[entries + 1] - gram_at[entries]
            gs = np.concatenate([[0], np.cumsum(m)])
            own = b[np.repeat(gram_at[entries] - gs[:-1], m) + np.arange(gs[-1])]
            full = np.flatnonzero(m > 0)
            vectors = np.zeros((len(entries), WIDTH), dtype=np.float32)
            vectors[full] = np.add.reduceat(table[own], gs[:-1][full]) / m[full, None]
            runs, first = spans(starts, RUN)
            direction = softmax[:, 1] - softmax[:, 0]
            value = vectors @ direction
            first_time = once(inverse, runs)
            z = np.add.reduceat(value[inverse] * first_time, runs) * (scale / RUN)
            which = np.repeat(np.arange(len(docs)), np.diff(first))
            top = np.maximum.reduceat(z, first[:-1])
            share = np.exp(z - top[which])
            share /= np.add.reduceat(share, first[:-1])[which]
            p = 1 / (1 + np.exp(-(top + bias[1] - bias[0])))
            g = (p - y[docs]) * w[docs] / len(docs)  # of the logit
            of_run = (g[which] * share * (scale / RUN)).astype(np.float32)
            run_of_word = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, starts[-1])))
            of_entry = np.bincount(inverse, weights=of_run[run_of_word] * first_time, minlength=len(entries)).astype(np.float32)
            grad_direction = vectors.T @ of_entry
            spread = np.repeat(of_entry / np.maximum(m, 1), m)
            sums = np.bincount(own, weights=spread, minlength=BUCKETS).astype(np.float32)
            grads = [sums[:, None] * direction[None, :], np.stack([-grad_direction, grad_direction], 1), np.array([-g.sum(), g.sum()], dtype=np.float32)]
            for param, grad, (m1, m2) in zip((table, softmax, bias), grads, state, strict=True):
                m1 *= 0.9
                m1 += 0.1 * grad
                m2 *= 0.99
                m2 += 0.01 * grad * grad
                param -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
    direction = (softmax[:, 1] - softmax[:, 0]) * scale
    return Model((table @ direction).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = sample.ROWS_OF_CLASS) -> Model:
    """Learn from rows whose crc32(doc_id) mod 4 isn't 2, ``rows`` of each class at most."""
    from pyspark.sql import functions as F

    model = train(*sample.labelled(docs, labels, "toxic", sample.remainder(F.col("doc_id"), 4) != 2, rows))
    release()
    return model


def score_documents(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score double: the model (of a fixed size) over every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in size_chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(part.column(1)))], ["doc_id", "score"])

    return map_arrow(text_column(df, id_col, text_col), run, "doc_id long, score double")


def keep_rows(df: DataFrame, model, keep, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score satisfies ``keep`` (of an array of scores)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)
    numbered = df.toDF(*(f"c{i}" for i in range(len(df.columns))))  # whatever the columns' names

    def run(batches):
        for part in size_chunks(batches, f"c{at}"):
            yield part.filter(pa.array(keep(shared.value.scores(part.column(at)))))

    return map_arrow(numbered, run, numbered.schema).toDF(*df.columns)
