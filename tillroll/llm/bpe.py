"""Byte-level BPE encoding and decoding (operator 7).

Encoding is a backtracking search.  An Aho-Corasick automaton lists, for each
position of a word, the vocabulary entries that begin there.  The encoder takes
the longest one, and goes on as long as each new token is *compatible* with the
one before it: the two stand side by side in the merge-by-merge encoding of
their joined bytes.  If no entry fits at a position, the position is marked dead
and the previous token gives way to a shorter one.  Every position is marked at
most once, so the work is linear in the length, and the result is exactly what
merging by rank gives.  Compatibility is looked up in a table that is filled on
demand.

Decoding gathers the bytes of the tokens through an offset table: the bytes of
all tokens in one buffer, and each token's place and length in it.

Words repeat, so each Python worker keeps the encodings of the words it has met
(two generations of bounded size; a word that is dropped is encoded again).

Defined cases: a null text counts as empty; an empty text has no tokens; texts
of any length are encoded whole; repeated rows give repeated results; columns
other than the identifier and the text play no part.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_arrow, size_chunks, text_column, vocabulary

VOCABULARY = "byte_bpe_50k.json"
#: Words of one cache generation; two generations are kept in a worker.
CACHE_WORDS = 300_000
#: Pairs in the compatibility table.
CACHE_PAIRS = 500_000
#: Letters whose classes are the same in every Unicode version; other texts are split by the library's own splitter.
PLAIN = regex.compile(r"[\x00-\x1b\x20-ɏ‐-‧€]*")
#: Fixed value: the published splitting pattern of the vocabulary.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """A byte-level BPE vocabulary: encoder, decoder and their tables."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *added.values()]) + 1
        content = [b""] * size
        for token, i in vocab.items():
            content[i] = raw(token)
        for token, i in added.items():
            content[i] = token.encode()
        self.length = [len(x) for x in content]
        #: Offset table of the decoder.
        self.lengths = np.array(self.length, dtype=np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.buffer = np.frombuffer(b"".join(content), dtype=np.uint8)
        #: When a token is made: the rank of its merge, -1 for single bytes; and its two parts.
        self.birth, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.rank = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a_id, b_id, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[a_id << 24 | b_id] = rank
            if self.birth[whole] < 0:
                self.birth[whole], self.left[whole], self.right[whole] = rank, a_id, b_id
        self.automaton = ahocorasick.Automaton()
        self.whole = {}
        for i in vocab.values():
            key = content[i].decode("latin-1")
            self.whole[key] = i
            self.automaton.add_word(key, i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.words = Words(self)
        self.special = {t: np.array([i], dtype="<u4").tobytes() for t, i in added.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.path = path
        self.library = None

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves ``a`` and ``b`` side by side.

        The tokens at the boundary are taken apart again, the one made last
        first.  If at some stage the two that touch have a merge that comes
        before the next thing that happened to either, it would have joined them.
        """
        key = a << 24 | b
        known = self.pairs.get(key)
        if known is not None:
            return known
        birth, rank = self.birth, self.rank.get
        limit, fits = 1 << 60, True
        while True:
            merge = rank(a << 24 | b)
            if merge is not None and merge < limit:
                fits = False
                break
            if birth[a] > birth[b]:
                limit, a = birth[a], self.right[a]
            elif birth[b] >= 0:  # of two like merges the left one comes first
                limit, b = birth[b] + 1, self.left[b]
            else:
                break
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[key] = fits
        return fits

    def encode_word(self, word: str) -> list[int]:
        """Tokens of one word; ``word`` has a character for each byte."""
        token = self.whole.get(word)
        if token is not None:
            return [token]
        n, length, compatible = len(word), self.length, self.compatible
        begins: list[list[int]] = [[] for _ in range(n)]
        for end, token in self.automaton.iter(word):
            begins[end + 1 - length[token]].append(token)  # the longest comes last
        out, taken, dead = [], [], bytearray(n + 1)
        at, i, last = 0, len(begins[0]) - 1, -1
        while at < n:
            here = begins[at]
            while i >= 0:
                token = here[i]
                to = at + length[token]
                if not dead[to] and (last < 0 or compatible(last, token)):
                    break
                i -= 1
            if i >= 0:
                out.append(token)
                taken.append(i)
                at, last = to, token
                i = len(begins[at]) - 1 if at < n else 0
            else:
                dead[at] = 1
                at -= length[out.pop()]
                i = taken.pop() - 1
                last = out[-1] if out else -1
        return out

    def split(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return WORDS.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.split_special is not None and (parts := self.split_special.split(text))[1:]:
            return b"".join(chain.from_iterable([self.special[x]] if i % 2 else map(self.words.__getitem__, self.split(x)) for i, x in enumerate(parts)))
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens; a text's own are always whole UTF-8."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ends) or not ends[-1]:
            return b""
        return self.buffer[np.repeat(self.offsets[ids] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()


class Words(dict):
    """Encodings of the words met so far; the generation before the last stays in ``older``."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.older = codec, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = np.array(self.codec.encode_word(word.encode("utf-8", "surrogatepass").decode("latin-1")), dtype="<u4").tobytes()
        if len(word) <= 64:  # long ones seldom repeat
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each vocabulary in a worker process, kept between tasks."""
    return Codec(path)


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens long, ids array<int>: the tokens of every whole text."""
    path = vocabulary(VOCABULARY, path)

    def run(batches):
        c = codec(path)
        for part in size_chunks(batches, "text"):
            ids = [np.frombuffer(c.encode(t), dtype="<u4").astype(np.int32) for t in part.column(1).to_pylist()]
            n = [len(x) for x in ids]
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), flat], ["doc_id", "n_tokens", "ids"])

    return map_arrow(text_column(df, id_col, text_col), run, "doc_id long, n_tokens long, ids array<int>")


def decode_documents(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id, text: the ids of each row read back; null ids count as none.

    Bytes that aren't UTF-8 (from ids that cut a character) become U+FFFD.
    """
    path = vocabulary(VOCABULARY, path)

    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = [c.decode(np.array(x or [], dtype=np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(df.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{ids_col}` as ids"), run, "doc_id long, text string")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode every text and decode the ids again, in one pass without a shuffle.

    doc_id, n_tokens long, ids_sha256, decoded_sha256 string, same boolean
    (whether the decoded text is the text).
    """
    path = vocabulary(VOCABULARY, path)

    def run(batches):
        c, digest = codec(path), lambda x: hashlib.sha256(x).hexdigest()
        for part in size_chunks(batches, "text"):
            rows = []
            for text in part.column(1).to_pylist():
                ids = c.encode(text)
                back = c.decode(np.frombuffer(ids, dtype="<u4")).decode("utf-8", "replace")
                rows.append((len(ids) // 4, digest(ids), digest(back.encode()), back == text))
            n, a, b, same = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(same)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "same"])

    return map_arrow(text_column(df, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean")
