"""Words of text batches as arrays: one dictionary for each batch, no Python strings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import whole


@dataclass
class Words:
    """``index``: for each word its entry in the dictionary; document i has those
    from ``starts[i]`` to ``starts[i + 1]``, one at least (an empty text has the
    empty word).  Entry j has the bytes from ``offsets[j]`` to ``offsets[j + 1]`` of ``data``."""

    index: np.ndarray
    starts: np.ndarray
    offsets: np.ndarray
    data: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)


def split(column: pa.Array, lower: bool = False) -> Words:
    column = whole(column)
    if lower:
        column = pc.utf8_lower(column)
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(column))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.large_string())
    raw = words.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64, count=len(words) + 1 + words.offset)[words.offset :]
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, dtype=np.uint8)
    starts = lists.offsets.to_numpy().astype(np.int64)
    return Words(coded.indices.to_numpy().astype(np.int64), starts - starts[0], offsets - offsets[0], data[offsets[0] : offsets[-1]])


def spans(starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut each document's words into runs of ``size``: where the runs start among
    the words, and at which run each document starts (its number of runs follows)."""
    n = np.diff(starts)
    runs = -(-n // size)
    first = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(first[-1]) - np.repeat(first[:-1], runs)
    return np.repeat(starts[:-1], runs) + at * size, first
