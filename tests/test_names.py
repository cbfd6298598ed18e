import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowscope.detectors import names
from flowscope.operators.enrich import dga_score
from flowscope.operators.evaluate import roc_auc


def plain(labelled, wanted, order=3):
    """The same model and scores with dictionaries."""
    of = lambda name: "^" + name.split(".")[0].lower() + "$"
    count = {0: Counter(), 1: Counter()}
    for name, label in labelled:
        t = of(name)
        count[label].update(t[i - n : i] for i in range(1, len(t) + 1) for n in range(1, min(order, i) + 1))
    seen = set(count[0]) | set(count[1])
    kinds, totals = Counter(map(len, seen)), {c: Counter() for c in (0, 1)}
    for c in (0, 1):
        for g, k in count[c].items():
            totals[c][len(g)] += k
    share = lambda g, c: (count[c][g] + 1) / (totals[c][len(g)] + kinds[len(g)])
    odds = {g: math.log(share(g, 1) / share(g, 0)) for g in seen if count[0][g] + count[1][g] >= 5}
    labels = [label for _, label in labelled]
    bias = math.log((sum(labels) + 1) / (len(labels) - sum(labels) + 1))
    out = {}
    for name in wanted:
        t, total = of(name), bias
        for i in range(1, len(t) + 1):
            total += next((odds[t[i - n : i]] for n in range(min(order, i), 0, -1) if t[i - n : i] in odds), 0.0)
        out[name] = 1 / (1 + math.exp(-total))
    return out


def dealt(n):
    dice = random.Random(6)
    syllables = ["ba", "lo", "mi", "ren", "tos", "ka", "del"]
    out = []
    for i in range(n):
        label = i % 2
        body = "".join(dice.choice("bcdfghjklmnpqrstvwxz0123456789") for _ in range(12)) if label else "".join(dice.choice(syllables) for _ in range(4))
        out.append((f"{body}.example.com", label))
    return out


def test_against_plain(spark):
    rows = dealt(300)
    learn, held = rows[:200], [r[0] for r in rows[200:]] + ["ZZ", "a.b.c", "éß.com"]
    model = names.learn_names(spark.createDataFrame([*learn, (None, 1), ("", 0)], "domain string, label int"))
    wanted = spark.createDataFrame([(n,) for n in [*held, held[0], None, ""]], "domain string")
    got = {r.domain: r.prob for r in names.score_names(wanted, model).collect()}
    want = plain(learn, held)
    assert got.keys() == want.keys() and all(got[n] == pytest.approx(want[n]) for n in got)


def test_held_out_names_and_lookup(spark):
    rows = spark.createDataFrame(dealt(800), "domain string, label int")
    part = F.crc32(F.col("domain").cast("binary")) % 2 == 0
    scores = names.score_names(rows, names.learn_names(rows.where(part)))
    held = rows.where(~part).join(scores, "domain")
    assert roc_auc(held, "prob", "label").first()[0] > 0.95
    flows = rows.select(F.monotonically_increasing_id().alias("flow_id"), F.col("domain").alias("SNI")).limit(20)
    flows = flows.union(spark.createDataFrame([(-1, ""), (-2, None)], "flow_id bigint, SNI string"))
    looked_up = {r.flow_id: r.dom_dga_prob for r in dga_score(flows, scores).collect()}
    assert looked_up[-1] == looked_up[-2] == 0 and len(looked_up) == 22 and max(looked_up.values()) > 0.5


def test_empty(spark):
    none = spark.createDataFrame([], "domain string, label int")
    model = names.learn_names(none)
    assert names.score_names(spark.createDataFrame([("abc",)], "domain string"), model).first().prob == pytest.approx(0.5)
    assert names.score_names(none, model).collect() == []
