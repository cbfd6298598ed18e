import math
import random
import struct
from collections import Counter

import pytest
import xxhash
from brute import words

from flowscope.llm import quality as Q

SCHEMA = "doc_id bigint, text string, hashes int, score string, trusted int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0) for r in rows], SCHEMA)


def signed(x):
    return struct.unpack("<q", struct.pack("<Q", x))[0]


def grams(text):
    h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words(text)]
    one = lambda x, seed: xxhash.xxh64(struct.pack("<Q", x), seed=seed).intdigest()
    single = [signed(x) % Q.BUCKETS for x in h]
    return single + [signed(one(y, one(x, 42))) % Q.BUCKETS for x, y in zip(h, h[1:], strict=False)]


def counts(text):
    w, text = words(text), text or ""
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if seen[x] > 1:
            covered |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def ratios(rows, trusted):
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i is not None and i in trusted:
            target.update(grams(t))
    r, t = sum(raw.values()), sum(target.values())
    if not t:
        return lambda b: 0.0

    def ratio(b):
        seen, expected = target[b] + Q.SMOOTHING, raw[b] * (t / r) + Q.SMOOTHING
        x = math.log(seen / expected)
        return math.copysign(max(abs(x) - 2 * math.sqrt(1 / seen + 1 / expected) - math.log(2), 0.0), x)

    return ratio


def corpus():
    rng = random.Random(4)
    good, bad = [f"good{i}" for i in range(40)], [f"bad{i}###" for i in range(40)]
    rows = []
    for i in range(600):
        w = [rng.choice(good if i % 3 else bad) for _ in range(rng.randint(0, 60))]
        rows.append((i, "".join(x + rng.choice([" ", " ", "\n", "\t \x0b"]) for x in w)))
    rows += [
        (2200, None), (2201, ""), (2202, " \n\t"), (2203, "a b c d e\n" * 6), (2204, "x " * 500), (2205, "é ü ß" * 4), (2206, "one two three four"),
        (2207, "a b c d e f a b c d e"), (2208, "a a a a a a"), (2209, "line\n line\nline\r\nline\n\n\n"), (None, "good1 good2"), (1, rows[1][1]), (2210, "|<>" * 9),
    ]
    return rows


@pytest.mark.parametrize("trusted", [list(range(1, 600, 3)) + [1, None, 9999], []])
def test_against_brute_force(spark, trusted):
    rows = corpus()
    table = spark.createDataFrame([(i,) for i in trusted], "doc_id bigint")
    found = Q.quality(frame(spark, rows), table, -0.1).collect()
    assert len(found) == len(rows)
    ratio, texts = ratios(rows, set(trusted)), dict(rows)
    for r in found:
        want = counts(texts[r.id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        g = grams(texts[r.id])
        score = sum(map(ratio, g)) / len(g) if g else 0.0
        assert math.isclose(r.score, score, rel_tol=1e-9, abs_tol=1e-12)
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r.base_failed == failed and r.kept == (not failed and r.score >= -0.1)
    if trusted:
        assert {r.kept for r in found if not r.base_failed} == {True, False}


@pytest.mark.parametrize("lost", [0.0, 0.1, 0.5])
def test_threshold_is_a_quantile_of_trusted_scores(spark, lost):
    rows, trusted = corpus(), set(range(1, 600, 3))
    table = spark.createDataFrame([(i,) for i in trusted], "doc_id bigint")
    ratio = ratios(rows, trusted)
    steps = sorted(math.floor(sum(map(ratio, grams(t))) / len(grams(t)) * 10_000 + 1e-9) for i, t in rows if i in trusted and len(words(t)) >= 10)
    at = lost * (len(steps) - 1)
    low, high = steps[math.floor(at)], steps[math.ceil(at)]
    threshold = math.floor(low + (at - math.floor(at)) * (high - low)) / 10_000
    found = Q.quality(frame(spark, rows), table, lost=lost).collect()
    for r in found:
        assert r.kept == (not r.base_failed and r.score >= threshold)
    below = sum(r.score < threshold for r in found if r.id in trusted and r.n_words >= 10)
    assert below <= lost * len(steps)
    nobody = Q.quality(frame(spark, rows), table.where("false")).collect()
    assert all(r.score == 0.0 and r.kept == (not r.base_failed) for r in nobody)


def test_rare_insults_are_found_in_long_texts(spark):
    rng = random.Random(9)
    common = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join([*rng.choices(common, k=300), *(["insult"] if i % 5 == 0 else [])])) for i in range(1000)]
    trusted = spark.createDataFrame([(i,) for i in range(400) if i % 5], "doc_id bigint")
    verdicts = {r.id: r.kept for r in Q.quality(frame(spark, rows), trusted).collect()}
    assert not any(verdicts[i] for i in range(0, 1000, 5))
    assert sum(not verdicts[i] for i in range(1000) if i % 5) <= 0.03 * 800


def test_long_repeating_text(spark):
    half = [f"u{i}" for i in range(100_000)]
    rows = [(1, " ".join(half + half)), (2, " ".join(half + ["v", *half[:6]]))]
    found = {r.doc_id: r.n_repeat_words for r in Q.rule_counts(frame(spark, rows).drop("hashes")).collect()}
    assert found == {1: 200_000, 2: 12}


def test_empty(spark):
    docs, table = frame(spark, [(1, "a")]), spark.createDataFrame([(1,)], "doc_id bigint")
    assert Q.quality(docs.where("false"), table, 0.0).count() == 0
