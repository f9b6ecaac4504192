import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tillroll.llm import packing, queries
from tokenizers import Tokenizer

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abeinrst '\n!0éßΣİ", max_size=60))
def test_ids_as_the_library_gives_them(text):
    assert np.frombuffer(packing.tokens(PATH).encode(text), dtype="<u4").tolist() == ids_of(text)[:-1]


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "a <|startoftext|>b", "\x1c \x85\xa0", "It'S we'LL", "x" * 500])
def test_cases(text):
    assert np.frombuffer(packing.tokens(PATH).encode(text), dtype="<u4").tolist() == ids_of(text)[:-1]


def valid(rows, docs, capacity):
    """Every document's ids once, in order; sequences gapless and not too long."""
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        of_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for i, text in docs:
        ids = np.array(ids_of(text), dtype="<u4")
        for k in range(0, len(ids), capacity):
            want[i].append((k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())))
    assert {i: sorted(p) for i, p in of_doc.items()} == {i: sorted(p) for i, p in want.items()}
    for parts in of_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert 0 < at <= capacity
    return len(of_sequence), sum(n for parts in of_sequence.values() for _, n in parts)


def test_query(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    used, total = valid(queries.op2_packing(spark, small).collect(), docs, 2048)
    assert used <= -(-total // 2048) + 1


@pytest.mark.parametrize("block", [8, 4096])
def test_odd_rows(monkeypatch, odd, odd_rows, none, block):
    monkeypatch.setattr(packing, "BLOCK", block)
    rows = packing.pack_documents(odd, capacity=64).collect()
    valid(rows, [(i, t) for i, t, _ in odd_rows], 64)
    assert packing.pack_documents(none).count() == 0


def test_sequences(spark):
    df = spark.createDataFrame([(1, "one two three"), (2, "four"), (3, "five six " * 40)], "doc_id long, text string")
    with_ids = packing.pieces(df, capacity=32, with_ids=True)
    packed = packing.pack(with_ids.drop("ids"), 32)
    held = {r["sequence_id"]: np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist() for r in packing.sequences(packed, with_ids).collect()}
    ids = {i: ids_of(t) for i, t in ((1, "one two three"), (2, "four"), (3, "five six " * 40))}
    for r in packed.collect():
        assert held[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]


def whole(bins, n, length, capacity):
    assert sorted(x for b in bins for x in b) == list(range(n))
    assert all(sum(length[x] for x in b) <= capacity for b in bins)


@pytest.mark.parametrize("seed", range(5))
def test_genetic_operators_keep_every_piece(seed):
    rng = random.Random(seed)
    length = [rng.randint(1, 100) for _ in range(200)]
    population = packing.first_population(length, 100, rng)
    for p in population:
        whole(p, 200, length, 100)
    child = packing.crossover(population[0], population[-1], length, 100, rng)
    whole(child, 200, length, 100)
    whole(packing.mutate(child, length, 100, rng), 200, length, 100)
    later = packing.evolve(population, length, 100, rng)
    assert packing.fitness(later[0], length) <= min(packing.fitness(p, length) for p in population)
    assert packing.as_bins(packing.as_labels(later[0], 200)) == [sorted(b) for b in packing.as_bins(packing.as_labels(later[0], 200))]


def test_evolution_beats_best_fit():
    """Triplets that fill a bin exactly, where best fit wastes bins."""
    rng, length = random.Random(3), []
    for _ in range(60):
        a, b = rng.randint(380, 490), rng.randint(250, 310)
        length += [a, b, 1000 - a - b]
    start = packing.first_population(length, 1000, rng)
    best = packing.evolve(start, length, 1000, rng, children=400)[0]
    assert len(best) < len(start[0])
    whole(best, len(length), length, 1000)
