import random

import pytest
from brute import without_repeats

from flowscope.llm import substring as S

SCHEMA = "doc_id bigint, text string, chunk int, SPANS string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    shared = [[word() for _ in range(rng.randint(3, 90))] for _ in range(8)]
    rows = []
    for i in range(150):
        w = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            part, at = rng.choice(shared), rng.randint(0, len(w))
            a = rng.randrange(len(part))
            w[at:at] = part[a : a + rng.randint(1, 90)]
        rows.append((i, "".join(x + rng.choice([" ", "\n", "  "]) for x in w)))
    return [
        *rows, (200, None), (201, ""), (202, "a b c"), (203, "q " * 100), (204, rows[3][1]), (None, rows[5][1]), (3, "other text"),
        (205, " ".join(f"u{i}" for i in range(40)) + " é " + " ".join(f"u{i}" for i in range(40))),
    ]


@pytest.mark.parametrize("window, chunk_bytes", [(35, 700), (35, 8_000_000), (8, 2_000), (7, 500), (1, 3_000)])
def test_against_brute_force(spark, window, chunk_bytes):
    rows = corpus(window)
    found = S.repeated(frame(spark, rows), window, chunk_bytes=chunk_bytes).collect()
    want = [(i, n, n - len(kept), " ".join(kept)) for (i, _), (n, kept) in zip(rows, without_repeats([t for _, t in rows], window), strict=True)]
    assert sorted(((r.id, r.n_words, r.n_removed, r.kept_text) for r in found), key=str) == sorted(want, key=str)
    assert all(sum(x.end - x.first for x in r.spans) == r.n_removed for r in found)
    assert any(0 < r.n_removed < r.n_words for r in found)


def test_rows_that_repeat(spark):
    text = " ".join(f"v{i}" for i in range(40))
    found = S.repeated(frame(spark, [(1, text), (1, text)])).collect()
    assert [(r.n_words, r.n_removed, r.kept_text) for r in found] == [(40, 40, "")] * 2


def test_empty(spark):
    assert S.repeated(frame(spark, [(1, "a")]).where("false")).count() == 0
