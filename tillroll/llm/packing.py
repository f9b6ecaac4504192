"""Best-fit packing (operator 2): a grouping genetic algorithm on islands.

Documents become token ids (cut only where they exceed a sequence) and the
pieces are packed into as few sequences as possible.  Pieces are dealt at
random into blocks of about ``BLOCK`` pieces, and every block is evolved by
``ISLANDS`` islands, each a task of its own:

- an individual is a grouping: the bins, each with its pieces;
- crossover injects whole, well-filled bins of one parent into the other, drops
  the bins there that hold a duplicate, and puts the pieces that this displaces
  back by best fit, longest first;
- mutation empties some of the worst bins in the same way;
- after each round an island's elite migrates to the next island.

Fewer bins win, then fuller ones.  A block whose bins reach the lower bound
(tokens over capacity, rounded up) stops.  Blocks bound the memory of a task
whatever the input; each wastes less than one sequence against its own bound.
Poorly filled bins of all blocks are emptied once more into second blocks.

Defined cases: a null text counts as empty and still has its end token, so
every row is packed; repeated rows are packed each by itself; a text as long as
thousands of sequences is cut into full pieces and a rest; full pieces are
sequences of their own; extra columns play no part.
"""

from __future__ import annotations

import os
import random
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import cut, find_package, map_arrow, size_chunks, text_column, vocabulary

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END = 0
BLOCK = 4096
ISLANDS, ROUNDS = 2, 2
#: Most tasks of a round; beyond, a task takes several islands one after the other.
TASKS = 8192
POPULATION, CHILDREN = 6, 16
#: Bins of a first block that are filled less than this are packed again with those of other blocks.
GOOD = 0.97
CACHE_WORDS = 300_000
#: Letters on which Python and the library agree about case, white space and composition.
PLAIN = regex.compile(r"[\x00-įı-ɏ‐-‧€]*")
CONTROL = regex.compile(r"[\x1c-\x1f]")


#: Fixed value: the published splitting pattern of the vocabulary.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class Tokens(dict):
    """Token ids of texts exactly as the library gives them.

    The vocabulary drops white space, so a text's ids are those of its words in
    turn.  Words repeat: their ids are kept (two generations of bounded size), and
    new ones go through the library's own model.  A text with other letters
    than ``PLAIN`` has goes through the whole library.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = {b: c for c, b in byte_letters().items()}
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if word.isalpha() or (parts := WORDS.findall(word)) == [word]:
                letters = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
                ids = np.array([t.id for t in self.model.tokenize(letters)], dtype="<u4").tobytes()
            else:
                ids = b"".join([self[p] for p in parts])
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if (text.isascii() or PLAIN.fullmatch(text)) and not CONTROL.search(text) and not any(s in text for s in self.special):
            return b"".join(map(self.__getitem__, text.lower().split()))
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@lru_cache(maxsize=1)
def tokens(path: str) -> Tokens:
    return Tokens(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of every document (its ids, then ``end``), with their ids as binary if wanted."""
    path = vocabulary(VOCABULARY, path)
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches):
        t, size = tokens(path), 4 * capacity
        for part in size_chunks(batches, "text", 1 << 20):
            rows = []
            for at, text in enumerate(part.column(1).to_pylist()):
                ids = t.encode(text) + last
                for k in range(0, len(ids), size):
                    one = ids[k : k + size]
                    rows.append((at, k // size, k // 4, len(one) // 4, zlib.crc32(one), one))
            at, *columns, raw = zip(*rows, strict=True)
            kinds = [pa.int32(), *[pa.int64()] * 3]
            arrays = [part.column(0).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(raw, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return map_arrow(text_column(df, id_col, text_col), run, PIECES + ", ids binary" * with_ids)


Grouping = list[list[int]]


def best_fit(bins: Grouping, items: list[int], length: list[int], capacity: int) -> Grouping:
    """Put ``items`` into ``bins`` (changed in place), longest first, each where it leaves least room."""
    room = sorted((r << 24 | i) for i, b in enumerate(bins) if (r := capacity - sum(length[x] for x in b)) > 0)
    for x in sorted(items, key=lambda i: -length[i]):
        n = length[x]
        at = bisect_left(room, n << 24)
        if at == len(room):
            bins.append([x])
            left, to = capacity - n, len(bins) - 1
        else:
            key = room.pop(at)
            to = key & 0xFFFFFF
            bins[to].append(x)
            left = (key >> 24) - n
        if left:
            insort(room, left << 24 | to)
    return bins


def fitness(bins: Grouping, length: list[int]) -> tuple[int, int]:
    """Smaller is better: the number of bins, then how evenly they are filled."""
    return len(bins), -sum(sum(length[x] for x in b) ** 2 for b in bins)


def crossover(giver: Grouping, taker: Grouping, length: list[int], capacity: int, rng: random.Random) -> Grouping:
    ranked = sorted(giver, key=lambda b: -sum(length[x] for x in b))
    good = ranked[: max(1, int(len(ranked) * rng.uniform(0.2, 0.8)))]
    injected = [list(b) for b in good if rng.random() < 0.5] or [list(good[0])]
    there = {x for b in injected for x in b}
    kept, displaced = [], []
    for b in taker:
        if there.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [x for x in b if x not in there]
    return best_fit(injected + kept, displaced, length, capacity)


def mutate(bins: Grouping, length: list[int], capacity: int, rng: random.Random) -> Grouping:
    ranked = sorted((list(b) for b in bins), key=lambda b: -sum(length[x] for x in b))
    worst = max(2, len(ranked) // 10)
    kept, emptied = ranked[:-worst], ranked[-worst:]
    some = rng.sample(range(len(kept)), min(len(kept), worst // 2)) if kept else []
    for i in sorted(some, reverse=True):
        emptied.append(kept.pop(i))
    items = [x for b in emptied for x in b]
    rng.shuffle(items)
    seeds = items[: len(items) // 4]  # fitted first, whatever their length
    return best_fit(best_fit(kept, seeds, length, capacity), items[len(seeds) :], length, capacity)


def bound(length: list[int], capacity: int) -> int:
    return -(-sum(length) // capacity)


def first_population(length: list[int], capacity: int, rng: random.Random, size: int = POPULATION) -> list[Grouping]:
    out = [best_fit([], list(range(len(length))), length, capacity)]
    while len(out) < size and len(out[0]) > bound(length, capacity):
        seeds = rng.sample(range(len(length)), len(length) // 4)  # these come first, whatever their length
        inside = set(seeds)
        bins = best_fit([], seeds, length, capacity)
        out.append(best_fit(bins, [x for x in range(len(length)) if x not in inside], length, capacity))
    return out


def evolve(population: list[Grouping], length: list[int], capacity: int, rng: random.Random, children: int = CHILDREN) -> list[Grouping]:
    """The population after ``children`` births, best first."""
    ranked = sorted(((fitness(p, length), i, p) for i, p in enumerate(population)), key=lambda r: r[:2])
    least, born = bound(length, capacity), len(ranked)
    for _ in range(children):
        if ranked[0][0][0] <= least or len(ranked) < 2:
            break
        a, b = sorted(rng.sample(range(len(ranked)), 2))
        child = crossover(ranked[a][2], ranked[b][2], length, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, length, capacity, rng)
        born += 1
        score = fitness(child, length)
        if score < ranked[-1][0] and all(score != r[0] for r in ranked):
            ranked[-1] = (score, born, child)
            ranked.sort(key=lambda r: r[:2])
    return [p for _, _, p in ranked]


def as_labels(bins: Grouping, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.int32)
    for i, b in enumerate(bins):
        out[b] = i
    return out


def as_bins(labels: np.ndarray) -> Grouping:
    order = np.argsort(labels, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1)] if len(labels) else []


_STATE = "block long, island int, guest boolean, rank int, bins int, lengths binary, labels binary"
_STATE_NAMES = ["block", "island", "guest", "rank", "bins", "lengths", "labels"]
_STATE_TYPES = [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
_ORDER = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("uid", "ascending")]


def _state(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(_STATE_NAMES)
    return pa.table([pa.array(c, t) for c, t in zip(columns, _STATE_TYPES, strict=True)], names=_STATE_NAMES)


def _evolved_blocks(items: DataFrame, blocks: int, capacity: int, seed: int) -> DataFrame:
    """block, labels: the best grouping of each block's items, in the order of ``_ORDER``."""

    def start(part: pa.Table) -> pa.Table:
        block = part["block"][0].as_py()
        lengths = np.sort(part["length"].to_numpy())[::-1].astype(np.int32).tobytes()
        return _state([(block, i, False, -1, -1, lengths, b"") for i in range(ISLANDS)])

    def live(part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        block, island = rows[0]["block"], rows[0]["island"]
        length = np.frombuffer(rows[0]["lengths"], dtype=np.int32).tolist()
        turn = max(r["rank"] for r in rows) // 100 + 1
        rng = random.Random(f"{seed} {block} {island} {turn}")
        seen = sorted((r for r in rows if r["rank"] >= 0), key=lambda r: (r["guest"], r["rank"]))
        population = [as_bins(np.frombuffer(r["labels"], dtype=np.int32)) for r in seen] or first_population(length, capacity, rng)
        population = evolve(population, length, capacity, rng)[:POPULATION]
        out = [(block, island, False, 100 * turn + k, len(p), rows[0]["lengths"], as_labels(p, len(length)).tobytes()) for k, p in enumerate(population)]
        if ISLANDS > 1:  # the elite goes to the next island
            out.append((block, (island + 1) % ISLANDS, True, *out[0][3:]))
        return _state(out)

    state = items.groupBy("block").applyInArrow(start, _STATE)
    for _ in range(ROUNDS):
        # A given number of tasks: they are small in bytes, not in work, so they aren't put together.
        state = state.repartition(min(TASKS, blocks * ISLANDS), "block", "island").groupBy("block", "island").applyInArrow(live, _STATE)
    return state.groupBy("block").agg(F.min_by("labels", F.struct("bins", "rank", "island", "guest")).alias("labels"))


def _placed(items: DataFrame, best: DataFrame, capacity: int, finish: bool) -> DataFrame:
    """Items with ``sequence_id`` and ``offset``; unless ``finish``, those of poorly filled bins get none."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by(_ORDER)
        labels = np.frombuffer(right["labels"][0].as_py(), dtype=np.int32)
        length = left["length"].to_numpy()
        order = np.argsort(labels, kind="stable")
        fill = np.bincount(labels, weights=length)
        ends = np.cumsum(length[order])
        first = np.concatenate([[True], np.diff(labels[order]) != 0])
        offset = np.empty(len(labels), dtype=np.int64)
        offset[order] = ends - length[order] - np.maximum.accumulate(np.where(first, ends - length[order], 0))
        sequence = left["block"].to_numpy() * (1 << 24) + labels
        open_ = np.zeros(len(labels), dtype=bool) if finish else fill[labels] < GOOD * capacity
        return left.append_column("sequence_id", pa.array(sequence, mask=open_)).append_column("offset", pa.array(offset, mask=open_))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", sequence_id long, offset long"
    return items.groupBy("block").cogroup(best.groupBy("block")).applyInArrow(run, schema)


def pack(parts: DataFrame, capacity: int = CAPACITY, seed: int = 1) -> DataFrame:
    """The pieces (columns of :data:`PIECES`) with sequence_id and offset long."""
    find_package(parts.sparkSession)
    parts = cut(parts.withColumn("uid", F.monotonically_increasing_id()))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = parts.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    rest = parts.where(F.col("length") < capacity)

    def blocked(items: DataFrame, blocks: int, first: int) -> DataFrame:
        return items.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "uid"), F.lit(blocks)) + first)

    blocks = max(1, round(rest.count() / BLOCK))
    items = blocked(rest, blocks, 0)
    placed = cut(_placed(items, _evolved_blocks(items, blocks, capacity, seed), capacity, False))
    open_ = placed.where("sequence_id is null")
    more = max(1, round(open_.count() / BLOCK))
    again = blocked(open_.drop("block", "sequence_id", "offset"), more, blocks)
    last = _placed(again, _evolved_blocks(again, more, capacity, seed + 1), capacity, True)
    return full.select(columns).unionByName(placed.where("sequence_id is not null").select(columns)).unionByName(last.select(columns))


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(df, id_col, text_col, path, capacity), capacity)


def sequences(packed: DataFrame, with_ids: DataFrame) -> DataFrame:
    """sequence_id, ids binary: the packed sequences themselves.  ``with_ids``: the
    pieces with their ids, of a table without repeated identifiers."""
    both = packed.join(with_ids.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    held = both.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return held.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
