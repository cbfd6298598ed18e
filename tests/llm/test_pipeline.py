import os

import pytest
from brute import components, luhn, overlapping, shingles

import corpus_pipeline as C
from flowscope.llm import language as L

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _fresh string, Text_hash int"


def by_brute_force(spark, folder, docs):
    """Run the stages one by one, each checked on its own input; returns the last result's rows."""
    columns, schema = docs.columns, docs.schema
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    stages = dict(C.STAGES)
    model = L.dictionaries(docs)
    verdict = L.Classifier(model)

    def letters(text):
        return any(c.isalpha() for c in text or "")

    def good(text):
        name, score = verdict(text) if letters(text) else ("und", 0)
        return name != "und" and score >= C.LANGUAGE_MARGIN

    kept = stages["language"](spark, docs, folder)
    assert kept.columns == columns and kept.schema == schema
    want = [r for r in docs.collect() if good(r.text)]
    assert sorted(kept.collect(), key=str) == sorted(want, key=str)

    docs = spark.createDataFrame(want, schema) if want else docs.where("false")
    ids = [r.doc_id for r in want]
    out = stages["near_duplicates"](spark, docs, folder)
    assert out.columns == columns
    rows = out.collect()
    if len(set(ids)) == len(ids) and None not in ids:
        least = components({r.doc_id: shingles(r.text, 5) for r in want})
        assert sorted(r.doc_id for r in rows) == sorted(set(least.values()))
    assert len({str(sorted(shingles(r.text, 5))) for r in rows if r.text}) == len(rows)

    out = stages["decontamination"](spark, out, folder)
    assert out.columns == columns
    want = [r for r in rows if not overlapping(r.text, items)]
    rows = out.collect()
    assert sorted(rows, key=str) == sorted(want, key=str)

    out = stages["pii"](spark, out, folder)
    assert out.columns == columns
    before, rows = {str(r.doc_id) + r.source: r for r in rows}, out.collect()
    assert len(rows) == len(before)
    for r in rows:
        old = before[str(r.doc_id) + r.source]
        assert (r.lang, r.source) == (old.lang, old.source)
        assert r == old if r.text == old.text else r.n_chars == len(r.text)
        for m in __import__("re").finditer(r"(?<!\d)4\d{15}(?!\d)", old.text):
            assert not luhn(m[0]) or m[0] not in r.text

    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = sorted(library.encode(r.text, add_special_tokens=False).ids for r in rows)
    coded = stages["encoding"](spark, out, folder).collect()
    assert sorted(r.ids for r in coded) == texts
    return coded


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no benchmark tables here")
def test_tables(spark):
    coded = by_brute_force(spark, FOLDER, spark.read.parquet(f"{FOLDER}/documents.parquet"))
    assert 100 < len(coded) < 200
    assert sorted(C.run(spark, FOLDER).collect()) == sorted(coded)


def test_hard_rows(spark, tmp_path):
    english = "the man and the dog were in the house with that old fox and then the rain was there"
    german = "der mann und der hund waren im haus mit dem alten fuchs und dann war der regen da"
    item = "a benchmark question about the number of birds in the tree at the end of the day"
    rows = [
        (1, english, "en"), (2, german, "de"), (3, None, "en"), (4, "", None), (5, "123", "xx"), (6, english.upper(), None), (None, english, "en"),
        (7, german + " " + "und der regen " * 20_000, "de"), (8, english + " " + item, "en"), (9, "call +1 (017) 555-7713 when the man is in the house", "en"),
        (10, "the card 4785380592391139 was in the house", "en"), (10, "the card 4785380592391139 was in the house", "en"), (11, "\x00 the man ￿ and the dog", "en"),
    ]
    rows = [(i, t, lang, f"s{n}", None if t is None else len(t), "x", 1) for n, (i, t, lang) in enumerate(rows)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, item), (2, None), (None, ""), (3, item)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    by_brute_force(spark, str(tmp_path), docs)
    found = sorted(r.doc_id for r in C.run(spark, str(tmp_path)).collect())
    assert found == [1, 2, 7, 9, 10, 11]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


def test_stages():
    assert [name for name, _ in C.STAGES] == ["language", "near_duplicates", "decontamination", "pii", "encoding"]
    assert C.ORACLE_SQL is None
