import base64
import hashlib
from collections import Counter

import numpy as np
import pytest
from tillroll.llm import fingerprints, queries


def phrases(data):
    """Lempel-Ziv phrases as a set of byte strings, the unfinished last one included."""
    known, at = set(), 0
    for end in range(1, len(data) + 1):
        if data[at:end] not in known:
            known.add(data[at:end])
            at = end
    return known | ({data[at:]} - {b""})


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_hash(phrase):
    """A polynomial of the bytes, then two rounds of mixing, in whole numbers."""
    mask = (1 << 64) - 1
    h = sum((b + 1) * pow(int(fingerprints._BASE), i, 1 << 64) for i, b in enumerate(phrase)) & mask
    h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 & mask
    h = (h ^ h >> 29) * 0x94D049BB133111EB & mask
    return h >> 32


def plain_fingerprint(text):
    return sorted({plain_hash(p) for p in phrases(text.encode())})[:128]


def plain_likeness(a, b):
    """Of the 128 smallest hashes of both sets together, the share that both have."""
    if not a or not b:
        return float(a == b)
    smallest = sorted(set(a) | set(b))[:128]
    return sum(h in set(a) and h in set(b) for h in smallest) / len(smallest)


def edited(text, following):
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


@pytest.mark.parametrize("text", ["", "a", "aaaaaaaa", "abracadabra " * 20, "日本語 é😀" * 9])
def test_phrases(text):
    data, ends = text.encode(), []
    fingerprints.parse(data, {}, 0, 0, ends, [])
    cuts = [0, *ends, *([len(data)] if not ends or ends[-1] != len(data) else [])]
    assert {data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)} - {b""} == phrases(data)
    assert fingerprints.fingerprint(text).tolist() == plain_fingerprint(text)


def written(text):
    return base64.b64encode(np.array(plain_fingerprint(text), dtype="<u4").tobytes()).decode()


def check(rows, docs):
    docs = [(i, t or "") for i, t in docs]
    docs.sort(key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    want = Counter()
    for at, (i, text) in enumerate(docs):
        following = docs[(at + 1) % len(docs)][1]
        other = edited(text, following)
        want[(i, len(text), hashlib.sha256(other.encode()).hexdigest(), written(text), written(other))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want


def test_query(spark, small):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    rows = sorted(queries.op5_fingerprints(spark, small).collect(), key=lambda r: r["doc_id"])
    check(rows, docs)
    errors = []
    for at, r in enumerate(rows):
        text, following = docs[at][1], docs[(at + 1) % len(docs)][1]
        for near, other in ((r["near_edited"], edited(text, following)), (r["near_next"], following)):
            assert near == plain_likeness(plain_fingerprint(text), plain_fingerprint(other))
            a, b = phrases(text.encode()), phrases(other.encode())
            if len(a | b) <= 128:
                assert near == jaccard(a, b)
            errors.append(abs(near - jaccard(a, b)))
    assert np.mean(errors) < 0.05 and np.quantile(errors, 0.97) < 0.1
    assert np.mean([r["near_edited"] for r in rows]) > 0.5 > 0.25 > np.mean([r["near_next"] for r in rows])


@pytest.mark.parametrize("size", [2, 1000])
def test_odd_rows(monkeypatch, odd, odd_rows, none, size):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", size)
    rows = fingerprints.fingerprint_documents(odd).collect()
    check(rows, [(i, t) for i, t, _ in odd_rows])
    assert fingerprints.fingerprint_documents(none).count() == 0


def test_one_row_is_its_own_next(spark):
    (r,) = fingerprints.fingerprint_documents(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).collect()
    assert r["near_next"] == 1.0
    assert r["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def test_small_sets_are_exact():
    a, b = fingerprints.fingerprint("abcd"), fingerprints.fingerprint("abce")
    assert fingerprints.likeness(a, b) == 3 / 5
    assert fingerprints.likeness(a, a) == 1.0 == fingerprints.likeness(a[:0], b[:0])
    assert fingerprints.likeness(a, b[:0]) == 0.0
    assert (fingerprints.sketch_of(fingerprints.text_of(a)) == a).all()
