import itertools
import random

import pytest
from brute import overlapping, tokens

from flowscope.llm import decontaminate as D

DOCS = "doc_id bigint, text string, Overlaps string, item_id int"


def test_masks_hit_every_window():
    for gone in itertools.combinations(range(D.WINDOW), D.SUBSTITUTIONS):
        agree = set(range(D.WINDOW)) - set(gone)
        assert any(
            all(at + k in agree for k, c in enumerate(mask) if c == "1")
            for mask in D.MASKS for at in range(D.WINDOW - len(mask) + 1)
        )
    assert all(len(mask) <= D.SHORTEST for mask in D.MASKS)


def case(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta the of and 7 über".split()) + str(rng.randint(0, 30))
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 7, 8, 12, 13, 30, 30, 40])))) for i in range(25)]
    items += [(25, items[0][1]), (26, None), (27, ""), (28, items[4][1].upper().replace(" ", ", "))]
    docs = []
    for i in range(120):
        w = [word() for _ in range(rng.randint(0, 40))]
        if i % 2:
            part = tokens(items[rng.randrange(25)][1])
            a = rng.randrange(len(part) // 3 + 1)
            part = part[a : a + rng.randint(8, 30)]
            for _ in range(rng.randint(0, 3)):
                part[rng.randrange(len(part))] = word()
            at = rng.randint(0, len(w))
            w[at:at] = part
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    return items, [*docs, (200, None), (201, ""), (None, docs[1][1]), (1, docs[1][1])]


@pytest.mark.parametrize("block_bytes", [400, 4_000_000])
def test_against_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(D, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(D, "SLICE_BYTES", 500)
    items, rows = case(block_bytes)
    table = spark.createDataFrame(items, "item_id bigint, text string")
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], DOCS)
    alike = {}
    for i, t in items:
        alike.setdefault(tuple(tokens(t)), []).append(i)
    name = {i: same[0] for same in alike.values() for i in same}
    found = D.overlaps(docs, table).collect()
    assert len(found) == len(rows)
    text = dict(rows)
    dirty = set()
    for r in found:
        want = {name[i] for i in overlapping(text[r.id], items)}
        assert {name[x.item_id] for x in r.overlaps} == want
        for x in r.overlaps:
            assert 0 <= x.first < x.end <= len(tokens(text[r.id]))
        dirty |= {r.id} if want else set()
    assert 15 < len(dirty) < 100
    kept = D.decontaminated(docs, table)
    assert kept.schema == docs.schema
    assert sorted(kept.collect(), key=str) == sorted((r for r in docs.collect() if r.doc_id not in dirty), key=str)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "A b, c d e f g h i j k l m!", "x", 5)], DOCS)
    assert D.overlaps(docs.where("false"), items).count() == 0
    assert [r.overlaps for r in D.overlaps(docs, items.where("false")).collect()] == [[]]
    assert D.decontaminated(docs, items.where("false")).count() == 1
    assert D.decontaminated(docs, items).count() == 0
    span = D.overlaps(docs, items).first().overlaps
    assert [(x.item_id, x.first, x.end) for x in span] == [(1, 0, 13)]
