import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowscope.llm import sequences as S

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

CASES = [
    "", " ", "Hello  World\n\nDon't!", "a <|startoftext|> b<|endoftext|>c", "É é ́x", "ΟΔΟΣ ΣΑΣ", "x y　z\x85\x1c\x0bq", "​ a b",
    "12 345 '''s ... \"", "x" * 300, "中文 текст 🙂", "a\t\tb\r\nc \u0085 d",
]


@pytest.fixture(scope="module")
def path():
    return public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(path):
    return tokenizers.Tokenizer.from_file(path)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t\xa0　́aAÉΣσİßªµ²1'é中!.<|>​\x85\xad"), max_size=20) | st.text(max_size=20), max_size=4))
def test_pieces_give_the_ids_of_whole_texts(path, library, texts):
    encoder = S.Encoder(path, 1)
    assert encoder.by_word
    for text, found in zip([*texts, *CASES], encoder([*texts, *CASES]), strict=True):
        assert np.frombuffer(found, "<u2").tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]


def test_other_vocabularies_and_forgetting(path, library, monkeypatch):
    other = S.Encoder(public.path("byte_bpe_50k.json"), 1)
    whole = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    assert not other.by_word
    for text, found in zip(CASES, other(CASES), strict=True):
        assert np.frombuffer(found, "<u2").tolist() == [*whole.encode(text, add_special_tokens=False).ids, 1]
    monkeypatch.setattr(S, "KEPT_PIECES", 2)
    monkeypatch.setattr(S, "KEPT_UNITS", 2)
    small = S.Encoder(path, 1)
    for _ in range(2):
        for text, found in zip(CASES, small(CASES), strict=True):
            assert np.frombuffer(found, "<u2").tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]


def expected(library, rows):
    start, out = 0, []
    for ident, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((ident, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_round_trip_over_shards_and_batches(spark, path, library, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BATCH_ROWS", 3)
    monkeypatch.setattr(S, "KEPT_PIECES", 5)
    rows = [(i * 7 % 97 - 20, f"{CASES[i % len(CASES)]} text number {i} " * (1 + i % 9)) for i in range(97)] + [(200, None), (201, "word " * 6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    folder = f"file://{tmp_path}/files"
    manifest = S.write_sequences(docs, folder, path, length=16, shard_bytes=9000)
    assert manifest.count() > 2
    got = S.read_documents(spark, manifest, folder, "bigint", ids=True).collect()
    assert sorted(tuple(r)[:4] for r in got) == expected(library, sorted(rows, key=lambda r: r[0]))
    everything = [i for r in sorted(got, key=lambda r: r.start) for i in r.ids]
    first, start = 0, 0
    for shard in sorted(manifest.collect(), key=lambda r: r.shard):
        files = S.Sequences(folder, shard.name)
        assert (len(files), shard.first_sequence, shard.start) == (shard.sequences, first, start)
        masks = [np.array(files.mask(i)) for i in range(len(files))]
        ids = np.concatenate([files.ids(i)[m] for i, m in enumerate(masks)])
        assert all(len(files.ids(i)) == 16 for i in range(len(files))) and all(m.all() for m in masks[:-1])
        assert ids.tolist() == everything[start : start + shard.tokens]
        begins = np.flatnonzero(np.concatenate([np.array(files.mask(i, "first")) for i in range(len(files))]))
        assert (begins + start).tolist() == sorted(r.start for r in got if start <= r.start < start + shard.tokens)
        first, start = first + shard.sequences, start + shard.tokens


def test_sequences_are_not_copied(spark, path, tmp_path):
    docs = spark.createDataFrame([(1, "some words " * 500)], "doc_id bigint, text string")
    folder = f"file://{tmp_path}/files"
    shard = S.write_sequences(docs, folder, path, length=32).first()
    before = pa.total_allocated_bytes()
    files = S.Sequences(folder, shard.name)
    parts = [files.ids(i) for i in range(len(files))]
    assert not any(p.flags.owndata or p.flags.writeable for p in parts) and parts[0].dtype == np.uint16
    assert pa.total_allocated_bytes() - before < 4096


def test_hard_rows(spark, path, library, tmp_path):
    rows = [(None, "nothing", 1), (5, "same", 1), (5, "same", 2), (5, "other", 3), (3, None, 4), (4, "", 5)] + [(9, "copy", 6)] * 300
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, START int").withColumnRenamed("START", "Name")
    folder = f"file://{tmp_path}/files"
    manifest = S.write_sequences(docs, folder, path, shard_bytes=500)
    got = sorted(map(tuple, S.read_documents(spark, manifest, folder, "bigint").collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 3, 4, 5, 5, 5, *[9] * 300]
    assert manifest.count() > 3  # equal rows of one id lie in several shards
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    assert got[1][2:] == got[2][2:] == (1, zlib.crc32(b"\x01\0\0\0"))
    empty = S.write_sequences(docs.limit(0), f"file://{tmp_path}/none", path)
    assert empty.collect() == [] and S.read_documents(spark, empty, f"file://{tmp_path}/none", "bigint").collect() == []


def test_query_against_the_library(spark, library):
    from flowscope.llm.queries import op11_sequences

    folder = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    assert sorted(map(tuple, op11_sequences(spark, folder).collect())) == expected(library, rows)
