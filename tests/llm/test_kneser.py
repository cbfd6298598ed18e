import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import words

from flowscope.llm import kneser as K

SCHEMA = "doc_id bigint, text string, score double, __text string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1.0, "x") for r in rows], SCHEMA)


class Plain:
    """The model from dictionaries."""

    def __init__(self, texts):
        self.count, self.pairs = Counter(), Counter()
        for t in texts:
            w = [*words(t, True), None]
            self.count.update(w)
            self.pairs.update(zip(["<s>", *w[:-1]], w, strict=True))
        self.follow = Counter(w for _, w in self.pairs)
        self.d, self.e = self.discounts(self.pairs), self.discounts(self.follow)
        self.total, self.kinds = Counter(), defaultdict(lambda: [0, 0, 0, 0])
        for (u, _), k in self.pairs.items():
            self.total[u] += k
            self.kinds[u][min(k, 3)] += 1

    @staticmethod
    def discounts(counts):
        n = [0, *(sum(1 for c in counts.values() if c == k) for k in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        raw = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.0 for k in (1, 2, 3)]
        return [0.0, *(min(max(d, 0.0), k) for k, d in enumerate(raw, 1))]

    def prob(self, u, w):
        kinds = [0, 0, 0, 0]
        for c in self.follow.values():
            kinds[min(c, 3)] += 1
        spare = sum(self.e[k] * kinds[k] for k in (1, 2, 3)) / len(self.pairs)
        c = self.follow.get(w, 0)
        low = (c - self.e[min(c, 3)]) / len(self.pairs) + spare / (len(self.count) + 1)
        if u not in self.total:
            return low
        k = self.pairs.get((u, w), 0)
        weight = sum(self.d[i] * self.kinds[u][i] for i in (1, 2, 3)) / self.total[u]
        return (k - self.d[min(k, 3)]) / self.total[u] + weight * low

    def row(self, text):
        w = [*words(text, True), None]
        n, v = sum(self.count.values()), len(self.count)
        base = sum(math.log10((self.count.get(x, 0) + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10(self.prob(u, x)) for u, x in zip(["<s>", *w[:-1]], w, strict=True))
        return len(w), sum(x in self.count for x in w), n, base, score


def texts(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("bucket_bytes", [300, 10_000_000])
def test_against_dictionaries(spark, monkeypatch, bucket_bytes):
    monkeypatch.setattr(K, "BUCKET_BYTES", bucket_bytes)
    train = [*texts(150, 1), "THE end", None, "", "w0 w0 w0 w0 w0", "w0 w0 w0 w0 w0"]
    model = K.learned(frame(spark, list(enumerate(train))))
    if bucket_bytes == 300:
        assert model.words.buckets > 20 and len(model.words.hot) > 2
    test = [*texts(40, 2), None, "", "never seen words", "The w0 w1 Ünknown w0", "x" * 5000, "w1 " * 3000]
    plain = Plain(train)
    rows = K.scored(frame(spark, list(enumerate(test))), model).collect()
    assert len(rows) == len(test)
    for r in rows:
        n, known, total, base, score = plain.row(test[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
        assert math.isclose(r.perplexity, 10 ** (-score / n), rel_tol=1e-9)


def test_probabilities_sum_to_one():
    plain = Plain(texts(100, 5))
    for u in ("w0", "w3", "<s>", "never"):
        assert math.isclose(sum(plain.prob(u, w) for w in [*plain.count, "unknown"]), 1.0, rel_tol=1e-9)


def test_no_training_rows(spark):
    empty = frame(spark, [(1, "a")]).where("false")
    model = K.learned(empty)
    rows = K.scored(frame(spark, [(1, "a b"), (2, None)]), model).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in sorted(rows)] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert K.scored(empty, model).count() == 0


def test_discounts_stay_in_range():
    for n in ([0, 0, 0, 0], [5, 0, 0, 0], [1, 9, 1, 9], [3, 1, 0, 4]):
        d = K.discounts(n)
        assert (d >= 0).all() and (d <= np.array([0, 1, 2, 3])).all()
