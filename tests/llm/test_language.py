import os
import zlib

import pytest

from flowscope.llm import language as L
from flowscope.llm import queries

TRAIN = [
    ("the quick brown fox and the lazy dog were in the house with that man", "en"),
    ("der schnelle braune fuchs und der faule hund waren im haus mit dem mann", "de"),
    ("le renard brun rapide et le chien paresseux dans la maison avec cet homme", "fr"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, Score double, lang_pred string, _lettered boolean"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, None, "x", None) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate(TRAIN * 3)] + [(90, None, "en"), (91, "text", None), (92, "1234", "zz")]
    return L.dictionaries(frame(spark, rows))


def test_model(model):
    assert sorted(model) == ["de", "en", "fr"]
    assert all(0 < len(d) <= L.DICTIONARY_BYTES for d in model.values())


def test_cases(spark, model):
    rows = [
        (1, "the dog and the man in the house", "x"), (2, "der hund und der mann im haus", None), (3, None, "en"), (4, "", "en"),
        (5, "123 !! 45", "en"), (6, "le chien dans la maison avec " * 3000, "en"), (6, "le chien dans la maison avec " * 3000, "en"), (None, "the quick dog and the lazy man were in the house", None),
    ]
    found = L.identify(frame(spark, rows), model).collect()
    got = sorted(((r.doc_id or 0, r.lang_pred) for r in found))
    assert got == [(0, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "fr"), (6, "fr")]
    assert all(0 <= r.score <= 1 for r in found) and all(r.score == 0 for r in found if r.lang_pred == "und")


def test_filter_keeps_columns(spark, model):
    docs = frame(spark, [(1, "the dog and the man in the house", "a"), (2, None, "b"), (3, "99", None), (4, "q", None)])
    kept = L.keep_identified(docs, model, 0.01)
    assert kept.schema == docs.schema
    assert [(r.doc_id, r.lang, r.lang_pred) for r in kept.collect()] == [(1, "a", "x")]
    assert L.keep_identified(docs.where("false"), model, 0.01).count() == 0


def test_no_and_one_language(spark):
    docs = frame(spark, [(1, "some text", None)])
    assert L.dictionaries(docs) == {}
    assert [(r.lang_pred, r.score) for r in L.identify(docs, {}).collect()] == [("und", 0.0)]
    assert [(r.lang_pred, r.score) for r in L.identify(docs, {"en": b"the text of the"}).collect()] == [("en", 1.0)]


def test_too_many_languages(spark):
    docs = frame(spark, [(i, f"text {i}", f"l{i}") for i in range(L.MAX_LANGUAGES + 1)])
    with pytest.raises(ValueError):
        L.dictionaries(docs)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no benchmark tables here")
def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op1_language(spark, folder).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)
    sure = [r for r in held if r.accepted]
    assert len(sure) >= 0.95 * len(held)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in sure) >= 0.99 * len(sure)
