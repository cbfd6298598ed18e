import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowscope.llm import negatives as N

SCHEMA = "vec_id bigint, label int, vector array<bigint>, Score string"


def plain(rows, every=5, k=5, low=80, high=100):
    """(anchor, positive, rank, negative, scores) by all products; rows count each for themselves."""
    rows = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]
    out = []

    def best(pairs, n):
        return sorted(pairs, key=lambda p: (-p[0], p[1] is None, p[1] or 0))[:n]

    for i, (ident, label, vector, *_) in enumerate(rows):
        if ident is None or ident % every:
            continue
        scored = [(sum(a * b for a, b in zip(vector, r[2], strict=False)), r[0], r[1]) for j, r in enumerate(rows) if j != i]
        for p, positive, _ in best([s for s in scored if s[2] == label], k):
            inside = [s for s in scored if s[2] != label and low * p <= 100 * s[0] <= high * p]
            out += [(ident, positive, n + 1, s[1], p, s[0]) for n, s in enumerate(best(inside, k))]
    return sorted(out, key=str)


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in N.hard_negatives(df, F.col("vec_id") % 5 == 0, **options).collect()), key=str)


def table(seed, n=300, dims=9, spread=60):
    dice = random.Random(seed)
    return [(i, dice.randint(0, 2), [dice.randint(-spread, spread) for _ in range(dims)], "x") for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_products(spark, monkeypatch, seed):
    monkeypatch.setattr(N, "BLOCK_ROWS", 37)
    rows = table(seed, spread=4 if seed == 1 else 60)  # small components give many ties
    assert got(spark, rows) == plain(rows)


def test_few_rows_and_other_parameters(spark):
    rows = table(3, n=12)
    assert got(spark, rows) == plain(rows)
    rows = table(4, n=120)
    assert got(spark, rows, positive_count=2, negative_count=7, percent=(10, 95)) == plain_with(rows, 2, 7, 10, 95)


def plain_with(rows, k, n, low, high):
    wide = plain(rows, k=10**6, low=low, high=high)
    first = {}
    for r in plain(rows, k=10**6, low=-(10**9), high=10**9):
        first.setdefault(r[0], set()).add((r[4], r[1]))
    allowed = {a: set(sorted(s, key=lambda x: (-x[0], x[1]))[:k]) for a, s in first.items()}
    return [r for r in wide if r[2] <= n and (r[4], r[1]) in allowed.get(r[0], ())]


def test_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    rows = table(5, n=60)
    rows += [(100, None, [1] * 9, "x"), (105, 1, None, "x"), (110, 1, [1, None], "x"), (None, 1, [9] * 9, "x"), (None, 0, [9] * 9, None)]
    rows += [(115, 2, [5, 5], "x"), (120, 0, [], "x"), (125, 1, [0] * 9, "x")] + [(130, 1, [3] * 9, "x")] * 40 + [(131, 0, [3] * 9, "x")] * 40
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == []
    assert got(spark, rows[60:63]) == []


def test_scores_beyond_64_bits_raise(spark):
    with pytest.raises(ValueError):
        got(spark, [(0, 1, [2**62], "x"), (1, 1, [-(2**63)], "x")])


def test_bitmap_shrinks_before_the_last_dimension():
    dice = np.random.default_rng(1)
    n, dims = 2000, 64
    matrix = np.floor(256 * dice.normal(0, 1, (n, dims)) / (1 + np.arange(dims)) ** 1.5).astype(np.int64)
    matrix[:20] = np.sort(matrix, 0)[-1]
    row = {"block": 0, "ids": list(range(n)), "labels": np.zeros(n, np.int64).tobytes(), "places": np.arange(n).tobytes(), "anchors": b""}
    row |= {"columns": np.ascontiguousarray(matrix.T).tobytes(), "lows": matrix.min(0).tobytes(), "highs": matrix.max(0).tobytes()}
    block, read = N.Block(row, dims), []
    real = N.Reading.added

    def counted(self, scores, rows, begin, end):
        read.append(len(rows) * (end - begin))
        return real(self, scores, rows, begin, end)

    N.Reading.added = counted
    try:
        rows, _ = N.positives(block, matrix[0], 0, 0, 5, N.LOWEST)
    finally:
        N.Reading.added = real
    assert set(rows.tolist()) <= set(range(20)) and sum(read) < n * dims / 2
