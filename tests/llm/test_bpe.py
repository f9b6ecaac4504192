import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tillroll.llm import bpe, queries
from tokenizers import Tokenizer

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(text):
    return np.frombuffer(bpe.codec(PATH).encode(text), dtype="<u4")


def check(text, library):
    ids = library.encode(text, add_special_tokens=False).ids
    assert ids_of(text).tolist() == ids
    assert bpe.codec(PATH).decode(np.array(ids, dtype=np.int64)).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    check(text, _library())


def _library(kept=[]):
    if not kept:
        kept.append(Tokenizer.from_file(PATH))
    return kept[0]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abeinrst '\n!0é", max_size=60))
def test_dense_text(text):
    check(text, _library())


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "a" * 5000, "ab" * 3000, "é" * 100, " " * 50 + "x", "I'll 've 'S", "\x1c\x85\u3000 x", "\U0001f468\u200d\U0001f469"])
def test_cases(text, library):
    check(text, library)


def test_every_token_is_its_own_encoding():
    c = bpe.codec(PATH)
    c.whole, kept = {}, c.whole  # so that words take the long way
    try:
        for word, token in list(kept.items())[::97]:
            assert c.encode_word(word) == [token]
    finally:
        c.whole = kept


def test_linear_time():
    import time

    c = bpe.codec(PATH)
    word = "abcdefgh" * 40_000
    start = time.thread_time()
    c.encode_word(word[:80_000])
    short = time.thread_time() - start
    start = time.thread_time()
    c.encode_word(word)
    assert time.thread_time() - start < 12 * short + 1


def test_query(spark, small, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    for r in queries.op7_bpe(spark, small).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), digest(np.array(ids, dtype="<u4").tobytes()))
        assert r["decoded_sha256"] == digest(library.decode(ids, skip_special_tokens=False).encode())


def test_odd_rows(odd, odd_rows, none):
    encoded = bpe.encode_documents(odd)
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in encoded.collect()) == sorted((i or 0, len(ids_of(t or ""))) for i, t, _ in odd_rows)
    back = bpe.decode_documents(encoded)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back.collect()) == sorted((i or 0, t or "") for i, t, _ in odd_rows)
    assert all(r["same"] for r in bpe.round_trip(odd).collect())
    assert bpe.round_trip(none).count() == 0 == bpe.encode_documents(none).count()
