import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowscope.llm import runs as R


def plain(words, least=24, cycles=3):
    """All runs, lag by lag."""
    n, found = len(words), {}
    for q in range(1, n // cycles + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            begin = i
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - begin + q >= max(least, cycles * q):
                found.setdefault((begin - q, i), q)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def coded(words):
    return R.numbered([w.encode() for w in words])


@settings(max_examples=400, deadline=None)
@given(
    st.lists(
        st.tuples(st.lists(st.sampled_from("ab"), min_size=1, max_size=40), st.integers(1, 12), st.lists(st.sampled_from("abc"), max_size=3)),
        max_size=5,
    )
)
def test_repeated_pieces(parts):
    words = [w for block, times, tail in parts for w in block * times + tail]
    assert R.found_runs(coded(words)) == plain(words)


@pytest.mark.parametrize("seed", range(60))
def test_nested_periods(seed):
    dice = random.Random(seed)
    words: list[str] = [dice.choice("ab") for _ in range(dice.randint(1, 5))]
    for _ in range(dice.randint(1, 4)):
        words = words * dice.randint(1, 5) + [dice.choice("abc") for _ in range(dice.randint(0, 4))]
        words = words[-dice.randint(1, 900) :]
    words = words * dice.randint(1, 4)
    assert R.found_runs(coded(words[:1500])) == plain(words[:1500])


def test_very_long_texts_in_linear_work():
    words = ["x"] * 400_000 + [str(i) for i in range(1000)] + ["a", "b", "c"] * 100_000
    assert R.found_runs(coded(words)) == [(0, 400_000, 1), (401_000, 300_000, 3)]
    starts = sum(1 for _ in R.opened(coded(words), 24, 3))
    assert starts < len(words)


def test_shortest_and_longest_periods():
    line = [f"w{i}" for i in range(8)]
    assert R.found_runs(coded(line * 3)) == [(0, 24, 8)]
    assert R.found_runs(coded((line * 3)[:-1])) == []
    assert R.found_runs(coded(["z"] * 24)) == [(0, 24, 1)]
    assert R.found_runs(coded(["z"] * 23)) == []
    block = [str(i) for i in range(777)]
    assert R.found_runs(coded(["q", *block * 3, "r"])) == [(1, 2331, 777)]


def test_hard_rows(spark):
    line = "one two three four five six seven eight nine "
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n\x0b\x0c\r ", "x"), (4, "short text", None), (5, line * 4 + "end", "x"), (5, line * 4 + "end", "x")]
    rows += [(None, "    a b", "x"), (7, "é ü " * 5000 + "z", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string").withColumnRenamed("runs", "Collapsed")
    got = sorted(R.periodic(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [r.n_words for r in got] == [0, 0, 0, 2, 37, 37, 10_001, 3]
    assert [[tuple(x) for x in r.runs] for r in got] == [[], [], [], [], [(0, 36, 9)], [(0, 36, 9)], [(0, 10_000, 2)], []]
    assert got[4].collapsed == line + "end" and got[6].collapsed == "é ü z" and got[7].collapsed == "    a b"
    assert [r.collapsed for r in got[:4]] == ["", "", "", "short text"]
    assert R.periodic(docs.limit(0)).collect() == []


def test_smaller_bounds_are_refused(spark):
    with pytest.raises(ValueError):
        R.periodic(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), cycles=2)


def test_query_against_plain(spark):
    import zlib

    from flowscope.llm.queries import op13_periodic

    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for row in op13_periodic(spark, folder).collect():
        words = (docs[row.doc_id] or "").encode().split()
        h, n = zlib.crc32(str(row.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if n > 4000:
            continue  # the plain version costs the square
        runs = plain(words)
        gone = np.zeros(n, bool)
        for s, length, q in runs:
            gone[s + q : s + length] = True
        text = b" ".join(w for w, x in zip(words, gone, strict=True) if not x)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        expected = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (len(runs), *expected)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(text).hexdigest()
