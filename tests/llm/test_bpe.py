import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowscope.llm import bpe as B

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

CASES = [
    "", "a", "  a  b\n\n c\t\td ", "AAAAAAA aaaaaaaaaaa", " x<|endoftext|> y <|endoftext|><|endoftext|>", "don't we'll  ",
    "héllo wörld　x y\x85 z\x1c \x1d", "12 345,67!! ... ***\n \n", "中文 текст العربية 🙂🙂 é", "\n\n\n a", "word " * 50 + "   ",
    "a" * 5000, "ab" * 3000, "\x00\x01 \x7f", "​ x  y", " ", "\t", "x\n", "'s'S 't",
]


@pytest.fixture(scope="module")
def vocabulary():
    return B.Vocabulary(public.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def test_cases(vocabulary, library):
    encoder = B.Encoder(vocabulary)
    for text, ids in zip(CASES, encoder.encode(CASES), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert encoder.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_forgetting_changes_nothing(vocabulary, library, monkeypatch):
    monkeypatch.setattr(B, "KEPT_UNITS", 3)
    monkeypatch.setattr(B, "ARRAY_SYMBOLS", 20)
    encoder = B.Encoder(vocabulary)
    for text in CASES:
        assert next(iter(encoder.encode([text]))).tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(" \n\t\xa0　abcAB12'é中!.<|>​"), max_size=20) | st.text(max_size=30))
def test_any_text(vocabulary, library, text):
    encoder = B.Encoder(vocabulary)
    ids = next(iter(encoder.encode([text])))
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert encoder.decode(ids) == text


def test_decoding_any_ids(vocabulary, library):
    encoder, rng = B.Encoder(vocabulary), np.random.default_rng(1)
    for _ in range(50):
        ids = rng.integers(0, 50_257, 20)
        assert encoder.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_frames(spark, vocabulary, library):
    texts = [*CASES, None, "long " * 40_000, "long " * 40_000]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, N_tokens int")
    coded = B.encode(docs, vocabulary).collect()
    assert len(coded) == len(texts)
    for r in coded:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    back = B.decode(B.encode(docs, vocabulary), vocabulary)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert B.encode(docs.where("false"), vocabulary).count() == 0
    missing = spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")
    assert B.decode(missing, vocabulary).first().text == ""
