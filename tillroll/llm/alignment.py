"""Cross-tokenizer alignment (operator 11): groups and links of two tokenizers' tokens.

Every text is encoded twice: with a leading space by a byte-level BPE vocabulary
(A), and by a piece model that adds such a space itself (B).  Both cut the same
bytes.  The documents of an Arrow batch are laid end to end, so a token's end is a
byte offset of the batch: the ends of A and of B are counted once each
(``bincount``), a *group* ends where both do, and a *link* (an A and a B token that
overlap) ends where any does, as two such tokens share exactly one run of bytes
without an end inside.  Prefix sums of these marks, taken at the documents' ends,
give each document's numbers, and at the tokens' ends each token's group.

Corpus-wide counts of linked pairs (in how many documents a pair of ids is linked)
never need a row for each pair of each document: a batch has a dictionary of its
pairs with the number of its documents that hold each; documents refer to it by
place.  Dictionaries are added up in Spark, and the sums come back to the batch
that asked for them, as a table of its size.

Defined cases: texts that are null or empty, and texts whose bytes one of the
encodings doesn't give back, have no tokens; control tokens' strings inside a text
are plain text; a null identifier stays null; repeated rows are documents of their
own, and count so; texts of any length are encoded whole; an empty table gives
none; other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import VOCABULARY, codec
from .common import cut, find_package, map_arrow, size_chunks, text_column, vocabulary

PIECES = "piece_bpe_32k.model"
#: Bytes of text that are aligned at once.
BATCH_BYTES = 3 << 19
#: Ids of both vocabularies are below this.
IDS = 1 << 24


class Pieces:
    """A piece model: its encoder, and the bytes of its pieces in an offset table."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        content = [self._bytes(i) for i in range(self.model.get_piece_size())]
        self.lengths = np.array([len(x) for x in content], dtype=np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.buffer = np.frombuffer(b"".join(content), dtype=np.uint8)

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One for each model in a worker process, kept between tasks."""
    return Pieces(path)


def joined(table, ids: np.ndarray) -> bytes:
    """The bytes of tokens, through the offset table of a :class:`Pieces` or a codec."""
    lengths = table.lengths[ids]
    ends = np.cumsum(lengths)
    return table.buffer[np.repeat(table.offsets[ids] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes() if len(ids) else b""


@dataclass
class Aligned:
    """Tokens of a batch of documents, end to end; ``*_of`` are boundaries of documents (one more than there are)."""

    a: np.ndarray
    b: np.ndarray
    a_of: np.ndarray
    b_of: np.ndarray
    groups_of: np.ndarray
    links_of: np.ndarray
    #: Group of each token, and the places in ``a`` and ``b`` of each link's tokens.
    a_group: np.ndarray
    b_group: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def bounds(sizes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))])


def align_tokens(a: list[np.ndarray], b: list[np.ndarray], a_lengths: np.ndarray, b_lengths: np.ndarray) -> Aligned:
    """The alignment of documents' tokens; a document's have the same bytes in ``a`` and ``b``."""
    a_of, b_of = bounds([len(x) for x in a]), bounds([len(x) for x in b])
    a, b = (np.concatenate([np.zeros(0, np.int32), *x]).astype(np.int32) for x in (a, b))
    a_ends, b_ends = np.cumsum(a_lengths[a]), np.cumsum(b_lengths[b])
    size = int(a_ends[-1]) + 1 if len(a) else 1
    in_a, in_b = (np.bincount(ends, minlength=size).astype(bool) for ends in (a_ends, b_ends))
    both, any_ = in_a & in_b, in_a | in_b
    groups, links = np.cumsum(both, dtype=np.int32), np.cumsum(any_, dtype=np.int32)  # a batch has fewer bytes than that
    ends = np.concatenate([[0], a_ends])[a_of]  # of documents
    at = np.flatnonzero(any_)
    before = lambda marks: np.cumsum(marks, dtype=np.int32)[at] - marks[at]
    return Aligned(a, b, a_of, b_of, groups[ends], links[ends], groups[a_ends] - both[a_ends], groups[b_ends] - both[b_ends], before(in_a), before(in_b))


def align_texts(texts: list[str | None], a_path: str, b_path: str) -> Aligned:
    c, p = codec(a_path), pieces(b_path)
    none = np.zeros(0, dtype=np.int32)
    a, b = [], []
    for text, theirs in zip(texts, p.model.encode([t or "" for t in texts], num_threads=1), strict=True):
        spaced = f" {text}"
        ours = np.frombuffer(b"".join(map(c.words.__getitem__, c.split(spaced))), dtype="<u4") if text else none
        theirs, data = np.array(theirs, dtype=np.int32), spaced.encode()
        # A's tokens are cut from these very bytes, so their number tells whether all are there.
        fits = bool(text) and joined(p, theirs) == data and int(c.lengths[ours].sum()) == len(data)
        a.append(ours if fits else none)
        b.append(theirs if fits else none)
    return align_tokens(a, b, c.lengths, p.lengths)


@lru_cache(maxsize=2)
def _written(a_size: int, b_size: int) -> list[str]:
    """Each id of A, then of B, with what follows it inside a group and at the end of its part."""
    return [f"{i}{x}" for size, last in ((a_size, "|"), (b_size, ";")) for i in range(size) for x in (",", last)]


def written_groups(x: Aligned, a_size: int, b_size: int) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` for each document: the ids of its groups in order."""
    words, out = _written(a_size, b_size), np.empty(len(x.a) + len(x.b), dtype=np.int64)
    last = lambda g: np.concatenate([g[1:] != g[:-1], [True]])[: len(g)]
    # A group's A tokens follow all tokens of the groups before, its B tokens the A tokens.
    out[np.arange(len(x.a)) + np.searchsorted(x.b_group, x.a_group)] = 2 * x.a + last(x.a_group)
    out[np.arange(len(x.b)) + np.searchsorted(x.a_group, x.b_group, "right")] = 2 * (a_size + x.b) + last(x.b_group)
    of = x.a_of + x.b_of
    return ["".join(map(words.__getitem__, out[s:e].tolist()))[:-1] for s, e in zip(of[:-1], of[1:], strict=True)]


def _lists(values: np.ndarray, of: np.ndarray, kind=None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.array(values.astype(kind or np.int32)))


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, a_ids, b_ids, a_ends, b_ends (arrays of int): the tokens of every text;
    of its groups the g-th has A tokens a_ends[g - 1] to a_ends[g] - 1 (from 0), and so B."""
    a_path, b_path = vocabulary(VOCABULARY, a_path), vocabulary(PIECES, b_path)

    def run(batches):
        for part in size_chunks(batches, "text", BATCH_BYTES):
            x = align_texts(part.column(1).to_pylist(), a_path, b_path)
            first = x.groups_of[:-1]
            ends = [bounds(np.bincount(g, minlength=x.groups_of[-1]))[1:] - np.repeat(of[:-1], np.diff(x.groups_of)) for g, of in ((x.a_group, x.a_of), (x.b_group, x.b_of))]
            columns = [_lists(x.a, x.a_of), _lists(x.b, x.b_of), *(_lists(e, np.append(first, x.groups_of[-1])) for e in ends)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])

    return map_arrow(text_column(df, id_col, text_col), run, "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
_ALIGNED = f"batch long, doc_id long, {', '.join(f'{n} long' for n in _NUMBERS)}, groups_sha256 string, places array<int>, times array<int>, pairs array<long>, held array<int>"


def described(df: DataFrame, id_col: str, text_col: str, a_path: str, b_path: str) -> DataFrame:
    """A row for each document, its pairs as places in the dictionary of its batch (with how often
    each is linked), and a row for each batch: ``pairs`` and the number of documents that hold each."""

    def run(batches):
        c, p = codec(a_path), pieces(b_path)
        first = TaskContext.get().partitionId() << 32
        for number, part in enumerate(size_chunks(batches, "text", BATCH_BYTES)):
            x = align_texts(part.column(1).to_pylist(), a_path, b_path)
            n = part.num_rows
            pairs, place = np.unique(x.a[x.link_a].astype(np.int64) * IDS + x.b[x.link_b], return_inverse=True)
            doc = np.repeat(np.arange(n), np.diff(x.links_of))
            own, times = np.unique(doc * max(1, len(pairs)) + place, return_counts=True)
            doc, place = np.divmod(own, max(1, len(pairs)))
            sha = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in written_groups(x, len(c.lengths), len(p.lengths))]
            of = bounds(np.bincount(doc, minlength=n))
            numbers = [pa.array(np.diff(v).astype(np.int64)) for v in (x.a_of, x.b_of, x.groups_of, x.links_of)]
            batch = pa.array(np.full(n, first + number))
            none = [pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))]
            names = ["batch", "doc_id", *_NUMBERS, "groups_sha256", "places", "times", "pairs", "held"]
            yield pa.RecordBatch.from_arrays([batch, part.column(0), *numbers, pa.array(sha, pa.string()), _lists(place, of), _lists(times, of), *none], names)
            if len(pairs):
                one = [pa.nulls(1, pa.int64()) for _ in range(5)] + [pa.nulls(1, pa.string())] + [pa.nulls(1, pa.list_(pa.int32()))] * 2
                held = np.bincount(place, minlength=len(pairs))
                yield pa.RecordBatch.from_arrays([batch[:1], *one, _lists(pairs, bounds([len(pairs)]), np.int64), _lists(held, bounds([len(pairs)]))], names)

    return map_arrow(text_column(df, id_col, text_col), run, _ALIGNED)


def pair_counts(dictionaries: DataFrame) -> DataFrame:
    """pair, n long (documents that hold it), best boolean (no pair with the same A id has more)."""
    counts = dictionaries.groupBy("pair").agg(F.sum("held").alias("n"))
    # A window holds the pairs of one A id: as many as B has ids at most.
    most = F.max("n").over(Window.partitionBy(F.expr(f"pair div {IDS}")))
    return counts.withColumn("best", F.col("n") == most)


def link_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum long, groups_sha256: one row for each row of ``df``.

    ``n_best``: links of which no other pair with the same A id is linked in more
    documents; ``count_sum``: the sum over all links of the documents that hold the pair.
    """
    find_package(df.sparkSession)
    rows = cut(described(df, id_col, text_col, vocabulary(VOCABULARY, a_path), vocabulary(PIECES, b_path)), keep=True)
    dictionaries = rows.where("pairs is not null").select("batch", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "x")).select("batch", "place", F.col("x.pairs").alias("pair"), F.col("x.held").cast("long").alias("held"))
    counted = dictionaries.join(pair_counts(dictionaries), "pair").select("batch", "place", "n", "best")
    docs = rows.where("pairs is null").select(F.col("batch").alias("own"), "doc_id", *_NUMBERS, "groups_sha256", "places", "times")

    def summed(docs: pa.Table, counted: pa.Table) -> pa.Table:
        """The documents of a batch with the sums of its dictionary's counts."""
        n, best = np.zeros(counted.num_rows, dtype=np.int64), np.zeros(counted.num_rows, dtype=np.int64)
        at = counted["place"].to_numpy()
        n[at], best[at] = counted["n"].to_numpy(), counted["best"].to_numpy()
        docs = docs.combine_chunks()
        values = lambda c: np.concatenate([np.zeros(0, np.int64), *(x.flatten().to_numpy() for x in docs[c].chunks)]).astype(np.int64)
        place, times = values("places"), values("times")
        of = bounds(np.concatenate([np.zeros(0, np.int64), *(x.value_lengths().to_numpy() for x in docs["places"].chunks)]))
        sums = [np.diff(bounds(times * of_pair[place])[of]) for of_pair in (best, n)]
        return docs.select(["doc_id", *_NUMBERS]).append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1])).append_column("groups_sha256", docs["groups_sha256"])

    schema = f"doc_id long, {', '.join(f'{n} long' for n in [*_NUMBERS, 'n_best', 'count_sum'])}, groups_sha256 string"
    return docs.groupBy("own").cogroup(counted.groupBy("batch")).applyInArrow(summed, schema)
