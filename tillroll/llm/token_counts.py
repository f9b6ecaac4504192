"""Token counts by field or section (operator 3): offset-mapped attribution.

Each document is encoded once, whole.  Every token has a span of characters
(the characters of which it holds a byte), every section has one, and an
interval join of the two gives each token its section.  A token that reaches
over a boundary goes to one section by the stated ``rule``:

- ``first``: the section with the token's first character;
- ``last``: the one with its last character;
- ``most``: the one with most of its characters, the earliest of equals.

So the counts of a document's sections always add up to its tokens.

Sections are the lines of a text, a line feed belonging to the line it ends, or
the fields of a record, joined by a separator that belongs to the field before it.

Defined cases: a null text or field counts as empty; a document always has at
least one section, perhaps an empty one with no tokens; an empty field has its
own row; repeated rows are counted each by itself; long texts are never cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import VOCABULARY, codec
from .common import map_arrow, size_chunks, text_column, vocabulary

RULES = ("first", "last", "most")
SCHEMA = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"


def character_of_byte(data: bytes) -> np.ndarray:
    """For each byte of UTF-8, the index of its character; one more entry for the end."""
    first = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
    return np.concatenate([np.cumsum(first) - 1, [int(first.sum())]])


def token_spans(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans [start, end) of consecutive tokens with these byte lengths."""
    ends = np.cumsum(lengths)
    if data.isascii():
        return ends - lengths, ends
    at = character_of_byte(data)
    return at[ends - lengths], at[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of these reach into another.

    ``bounds`` has the sections' starts and, last, the end of the text.
    """
    sections = len(bounds) - 1
    edges = bounds[1:-1]
    # Of sections with the same start only the last can hold characters.
    a = np.searchsorted(edges, starts, side="right")
    b = np.searchsorted(edges, ends - 1, side="right")
    crossing = a != b
    to = b.copy() if rule == "last" else a.copy()
    if rule == "most":
        for i in np.flatnonzero(crossing):
            inside = np.arange(a[i], b[i] + 1)
            shares = np.minimum(bounds[inside + 1], ends[i]) - np.maximum(bounds[inside], starts[i])
            to[i] = inside[np.argmax(shares)]
    return np.bincount(to, minlength=sections), np.bincount(to[crossing], minlength=sections)


def line_bounds(text: str, data: bytes) -> np.ndarray:
    feeds = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10) + 1
    if not data.isascii():
        feeds = character_of_byte(data)[feeds]
    if len(feeds) and feeds[-1] == len(text):
        feeds = feeds[:-1]
    return np.concatenate([[0], feeds, [len(text)]])


def _counted(texts, bounds_of, ids, path, rule):
    c, parts = codec(path), []
    for doc_id, text, bounds in zip(ids, texts, bounds_of, strict=True):
        data = text.encode()
        bounds = line_bounds(text, data) if bounds is None else bounds
        starts, ends = token_spans(data, c.lengths[np.frombuffer(c.encode(text), dtype="<u4")])
        n, crossing = attribute(starts, ends, bounds, rule)
        parts.append((np.arange(len(n)), bounds[:-1], bounds[1:], n, crossing, len(n), doc_id))
    columns = [np.concatenate([p[i] for p in parts]) for i in range(5)]
    doc_ids = pa.array([p[6] for p in parts], pa.int64()).take(pa.array(np.repeat(np.arange(len(parts)), [p[5] for p in parts])))
    kinds = [pa.int32(), *[pa.int64()] * 4]
    return pa.RecordBatch.from_arrays([doc_ids, *(pa.array(x).cast(k) for x, k in zip(columns, kinds, strict=True))], ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])


def count_line_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "first", path: str | None = None) -> DataFrame:
    """A row for each line of each document, with its span and its tokens."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = vocabulary(VOCABULARY, path)

    def run(batches):
        for part in size_chunks(batches, "text"):
            texts = part.column(1).to_pylist()
            yield _counted(texts, [None] * len(texts), part.column(0).to_pylist(), path, rule)

    return map_arrow(text_column(df, id_col, text_col), run, SCHEMA)


def count_field_tokens(df: DataFrame, fields: list[str], id_col: str = "doc_id", separator: str = "\n", rule: str = "first", path: str | None = None) -> DataFrame:
    """A row for each field (``section`` is its place in ``fields``) of each record,
    encoded as one text: the fields joined by ``separator``.  At least one field is asked for."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if not fields:
        raise ValueError("fields must name at least one column")
    path = vocabulary(VOCABULARY, path)
    values = [F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")).alias(f"f{i}") for i, f in enumerate(fields)]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = list(zip(*(part.column(i + 1).to_pylist() for i in range(len(fields))), strict=True))
                bounds = []
                for row in rows:
                    lengths = [len(x) + len(separator) for x in row]
                    lengths[-1] -= len(separator)
                    bounds.append(np.concatenate([[0], np.cumsum(lengths)]))
                yield _counted([separator.join(r) for r in rows], bounds, part.column(0).to_pylist(), path, rule)

    return map_arrow(df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *values), run, SCHEMA)
