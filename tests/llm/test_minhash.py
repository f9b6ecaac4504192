import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import oracle, same_rows
from tillroll.llm import minhash, queries

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def brute(docs, words):
    """doc_id -> (set size, component, kept) by comparing all pairs."""
    sets = [(i, shingles(t, words)) for i, t in docs]
    parent = {i: i for i, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return {i: (len(s), top(i), top(i) == i) for i, s in sets}


def grouped(df, words):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.group(df, words).collect()}


def variants(rng, n_groups=12, size=6):
    """Groups of texts that differ by a few words, near the threshold, in chains."""
    vocabulary = [f"w{i}" for i in range(400)]
    docs, i = [], 0
    for _ in range(n_groups):
        text = rng.choices(vocabulary, k=rng.choice([3, 8, 20, 60, 120]))
        for _ in range(size):
            docs.append((i, " ".join(text)))
            i += 1
            for _ in range(max(1, len(text) // 25)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("words", [2, 5])
def test_chains_and_borders(spark, words):
    docs = variants(random.Random(words))
    want = brute(docs, words)
    assert len({w[1] for w in want.values()}) not in (1, len(docs))
    assert grouped(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), words) == want


@pytest.mark.parametrize(("stars", "splits"), [(1, 2), (0, 0)])
def test_shared_passages_and_many_copies(spark, monkeypatch, stars, splits):
    """Small groups, so that buckets are large: further stars, splits, blocks."""
    monkeypatch.setattr(minhash, "GROUP_ROWS", 7)
    monkeypatch.setattr(minhash, "STARS", stars)
    monkeypatch.setattr(minhash, "SPLITS", splits)
    rng = random.Random(1)
    passage = [f"p{i}" for i in range(60)]
    docs = [(i, " ".join(passage + [f"x{i}_{k}" for k in range(rng.choice([3, 20]))])) for i in range(40)]
    docs += [(100 + i, "the same text again and again") for i in range(50)]
    docs += [(200 + i, " ".join(w if rng.random() < 0.97 else f"y{rng.random()}" for w in passage)) for i in range(60)]
    assert grouped(spark.createDataFrame(docs, "doc_id long, text string"), 2) == brute(docs, 2)


def test_query(spark, small):
    same_rows(queries.op8_minhash(spark, small), oracle(small).sql(queries.SQL["op8_minhash"]))


def test_odd_rows(odd, odd_rows, none):
    rows = minhash.group(odd, 2).collect()
    assert len(rows) == len(odd_rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    want = brute([(i, t) for i, t, _ in odd_rows if i is not None], 2)
    assert {i: v for i, v in got.items() if i is not None} == want
    assert got[None] == (3 - 1, None, True)
    assert minhash.group(none).count() == 0


def test_drop_duplicates(odd, none):
    kept = minhash.drop_duplicates(odd, 2)
    assert kept.dtypes == odd.dtypes
    key = lambda r: (r["doc_id"] or 0, r["text"] or "", r["_first_k"])
    assert {key(r) for r in kept.collect()} <= {key(r) for r in odd.collect()}
    again = minhash.drop_duplicates(odd.repartition(3), 2)  # the same row of those that tie
    assert sorted(map(key, again.collect())) == sorted(map(key, kept.collect()))
    assert sorted(r["doc_id"] or 0 for r in kept.select("doc_id").collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9]
    assert minhash.drop_duplicates(none).count() == 0


def plain_superminhash(elements, size):
    """One element after the other, with a whole permutation each."""
    mask = (1 << 64) - 1
    out = [mask] * size
    mix = lambda x: int(minhash.mix(np.array([x & mask], dtype=np.uint64))[0])
    for e in elements:
        p = list(range(size))
        for j in range(size):
            r = mix(int(e) + (j + 1) * int(minhash._P1))
            k = j + ((r & 0xFFFFFFFF) * (size - j) >> 32)
            p[j], p[k] = p[k], p[j]
            out[p[j]] = min(out[p[j]], j << 32 | r >> 32)
    return out


@pytest.mark.parametrize("n", [1, 3, 40])
def test_superminhash(n):
    elements = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
    got = minhash.superminhash(np.concatenate([elements, elements[:1]]), np.array([0, n, n, n + 1]), 20)
    assert got[0].tolist() == plain_superminhash(elements, 20)
    assert (got[1] == ~np.uint64(0)).all()
    assert got[2].tolist() == plain_superminhash(elements[:1], 20)


def test_estimates():
    rng, errors = np.random.default_rng(0), []
    for _ in range(100):
        a = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        b = np.concatenate([a[:267], rng.integers(0, 1 << 63, 33).astype(np.uint64)])
        s = minhash.superminhash(np.concatenate([a, b]), np.array([0, 300, 600]))
        errors.append((s[0] == s[1]).mean() - 267 / 333)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.0282


def test_slices_of_batches():
    texts = [f"É{i} Word word{i % 3} the" * (i % 5 + 1) for i in range(50)]
    column = pa.array(texts)
    value, starts = minhash.shingle_sets(column.slice(20, 20), 2)
    assert np.diff(starts).tolist() == [len(shingles(t, 2)) for t in texts[20:40]]
    again, _ = minhash.shingle_sets(pa.array(texts[20:40]), 2)
    assert (value == again).all()


def test_any_identifier(spark):
    """The largest and the smallest number are identifiers like others, beside a null one."""
    low, high = -(1 << 63), (1 << 63) - 1
    docs = [(high, "a text of its own"), (None, "nobody's text, once"), (None, "two texts that are alike"), (high - 1, "two texts that are alike"), (low, "one more pair here"), (0, "one more pair here"), (high, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in minhash.group(df, 2).collect())
    want = [(high, 4, high, True), (None, 2, None, True), (None, 4, high - 1, False), (high - 1, 4, high - 1, True), (low, 3, low, True), (0, 3, low, False), (high, 0, high, True)]
    assert got == sorted((str(i), n, str(c), k) for i, n, c, k in want)
    kept = sorted((str(r["doc_id"]), r["text"]) for r in minhash.drop_duplicates(df, 2).collect())
    assert kept == sorted((str(i), t) for i, t in [docs[0], docs[1], docs[3], docs[4], docs[6]])


def family(n, replaced, seed=3):
    """``n`` texts of 100 words, each with a share of a common text's words replaced by its own."""
    rng, base = random.Random(seed), [f"b{i}" for i in range(100)]
    return [(i, " ".join(f"o{i}_{k}" if rng.random() < replaced else w for k, w in enumerate(base))) for i in range(n)]


def copies_of(spark, monkeypatch, docs, words):
    """The result over ``docs`` with groups of 64 members at most, and how many sets are sent to be compared."""
    sent, deal = [], minhash.dealt
    monkeypatch.setattr(minhash, "GROUP_ROWS", 64)
    monkeypatch.setattr(minhash, "dealt", lambda groups, sets: sent.append(deal(groups, sets).count()) or deal(groups, sets))
    got = grouped(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), words)
    monkeypatch.undo()
    return got, sum(sent)


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Four times the members (4 and 16 times what a group holds) cost about four times the sets, not sixteen."""
    few, few_sent = copies_of(spark, monkeypatch, family(250, 0.01), 1)
    many, many_sent = copies_of(spark, monkeypatch, family(1000, 0.01), 1)
    assert len({c for _, c, _ in few.values()}) == len({c for _, c, _ in many.values()}) == 1
    assert many_sent <= 250 + 4**1.3 * few_sent


def test_large_groups_just_below_the_threshold(spark, monkeypatch):
    docs = family(300, 0.15)
    got, sent = copies_of(spark, monkeypatch, docs, 1)
    assert got == brute(docs, 1)
    assert len({c for _, c, _ in got.values()}) > 100
    assert sent <= 300 * 300  # far from a copy for each pair and prefix


def test_two_threads_keep_their_tables(spark):
    """Operators that run at once in one driver delete their own tables only."""
    import threading

    from tillroll.llm import common

    inside, leave, got = threading.Event(), threading.Event(), []

    def first():
        with common.temporary(spark):
            common.cut(spark.range(3))
            inside.set()
            leave.wait(60)

    thread = threading.Thread(target=first)
    thread.start()
    inside.wait(60)
    with common.temporary(spark):
        kept = common.cut(spark.range(5))
        leave.set()
        thread.join()
        got.append(kept.count())
    assert got == [5]
    with pytest.raises(Exception, match="(?i)not.?exist"):
        kept.count()


def family_with_others(n):
    """A family that is one component but for a fifth of its members, which are near it but not linked with it."""
    return family(n * 4 // 5, 0.02) + [(n + i, t) for i, t in family(n // 5, 0.15, 4)]


def test_families_with_others(spark, monkeypatch):
    """A set is sent for its hubs' groups and blocks, not for each bucket or each element of a prefix."""
    docs = family_with_others(300)
    got, sent = copies_of(spark, monkeypatch, docs, 1)
    assert got == brute(docs, 1)
    assert len({c for _, c, _ in got.values()}) > 40
    assert sent <= 20 * len(docs)


def test_rows_of_a_task_meet_in_any_number_at_once(monkeypatch):
    rng = random.Random(5)
    sets = [sorted({(w * 7919 + 11) % 100_003 for w in range(60) if rng.random() > p} | {200_000 + rng.randrange(90) for _ in range(int(60 * p))}) for p in rng.choices([0.02, 0.1, 0.3], k=80)]
    tokens, starts = np.concatenate(sets).astype(np.uint64), np.cumsum([0, *map(len, sets)])
    root = np.array([0 if i < 20 else i for i in range(80)])

    def parts(block):
        parent = {int(r): int(r) for r in root}
        for u, v in minhash._links(np.arange(80), root, block, tokens, starts):
            a, b = parent[int(root[u])], parent[int(root[v])]
            assert a != b
            parent = {k: min(a, b) if p in (a, b) else p for k, p in parent.items()}
        return parent

    def want(block):
        parent = {int(r): int(r) for r in root}
        for i, s in enumerate(sets):
            for j, t in enumerate(sets[:i]):
                if (block.any() and block[i] == block[j]) or 180 * len({*s} & {*t}) < 80 * (len(s) + len(t)):
                    continue
                a, b = parent[int(root[i])], parent[int(root[j])]
                parent = {k: min(a, b) if p in (a, b) else p for k, p in parent.items()}
        return parent

    for block in (np.zeros(80, dtype=int), np.arange(80) % 2):
        assert 1 < len(set(want(block).values())) < 60
        for pairs, marks in ((1 << 18, 1 << 20), (1, 1), (200, 1000)):
            monkeypatch.setattr(minhash, "PAIRS", pairs)
            monkeypatch.setattr(minhash, "MARKS", marks)
            assert parts(block) == want(block)
