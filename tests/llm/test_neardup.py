import random

import pytest
from brute import components, shingles

from flowscope.llm import neardup as N

SCHEMA = "doc_id bigint, text string, lang string, node binary, KEPT boolean, _text_hash int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", None, True, 7) for r in rows], SCHEMA)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 20, 60, 200]))]
        for _ in range(rng.choice([1, 2, 3, 10])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(w) // 40, len(w) // 15])):
                w[rng.randrange(len(w))] = word()
            rows.append(rng.choice([" ", "  ", "\n"]).join(x.upper() if rng.random() < 0.3 else x for x in w))
    base = [word() for _ in range(150)]  # a chain: each is like the one before, the ends are not alike
    for i in range(30):
        base[i * 3] = word()
        rows.append(" ".join(base))
    rng.shuffle(rows)
    return [(i + 10, t) for i, t in enumerate(rows)] + [(500, None), (501, ""), (502, " \n"), (503, "")]


@pytest.mark.parametrize("size", [4, 5])
def test_against_brute_force(spark, size):
    rows = corpus(size)
    sets = {i: shingles(t, size) for i, t in rows}
    want = components(sets)
    found = N.linked(frame(spark, rows), size).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.id]), want[r.id], want[r.id] == r.id)
    assert len({r.component_id for r in found}) < len(rows) - 20


def test_one_of_each_group_stays(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(5, a), (3, a.upper()), (3, a), (3, a), (None, a), (None, b), (None, b), (None, b + " "), (9, None), (9, None), (8, "")]
    docs = frame(spark, rows)
    kept = N.deduplicated(docs)
    assert kept.schema == docs.schema
    got = sorted(((r.doc_id or 0, r.text or "") for r in kept.collect()))
    # of an id that repeats with several texts, and of rows without any id, one row for each text
    assert got == [(0, b), (0, b + " "), (3, a.upper()), (3, a), (8, ""), (9, ""), (9, "")]


def test_large_group_of_copies(spark):
    rng = random.Random(1)
    base = [f"x{i}" for i in range(300)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(i % 5):
            w[rng.randrange(300)] = f"y{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    found = N.linked(frame(spark, rows)).collect()
    want = components({i: shingles(t, 4) for i, t in rows})
    assert {r.id: r.component_id for r in found} == want


def family(seed, texts, pairs):
    """Texts on one template, alike by 0.755, and for the first ones a partner each, alike by 0.804."""
    rng = random.Random(seed)
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    template = [f"t{i}" for i in range(360)]
    rows = [template + own(58) for _ in range(texts)]
    rows += [row[:373] + own(45) for row in rows[:pairs]]
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_pairs_in_a_family_that_is_not_alike(spark):
    rows = family(1, 500, 12)
    want = components({i: shingles(t, 4) for i, t in rows})
    assert len(set(want.values())) == 500
    assert {r.id: r.component_id for r in N.linked(frame(spark, rows)).collect()} == want


@pytest.mark.parametrize("sets", [40, 7])
def test_families_beyond_a_block(spark, monkeypatch, sets):
    monkeypatch.setattr(N, "BLOCK_SETS", sets)
    monkeypatch.setattr(N, "PASSES", 1)
    rows = family(2, 150, 10) + [(1000 + i, t) for i, t in corpus(9)]
    rng = random.Random(3)
    base = [f"c{i}" for i in range(200)]  # a component that fills several blocks by itself
    for i in range(90):
        w = list(base)
        w[rng.randrange(200)] = f"d{i}"
        rows.append((3000 + i, " ".join(w)))
    want = components({i: shingles(t, 4) for i, t in rows})
    assert {r.id: r.component_id for r in N.linked(frame(spark, rows)).collect()} == want


def test_very_long_texts(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    near = list(base)
    for _ in range(1500):
        near[rng.randrange(len(near))] = "x"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, "a b " * 100_000), (4, "y" * 1_000_000)]
    assert {r.id: r.component_id for r in N.linked(frame(spark, rows)).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_copies_without_distinct_ids(spark):
    rows = [(None, "one two three four five six")] * 2000 + [(7, "one two three four five six")] * 2000
    assert {(r.component_id, r.kept) for r in N.linked(frame(spark, rows)).collect()} == {(7, False), (7, True)}


def test_empty(spark):
    docs = frame(spark, [(1, "a")])
    assert N.linked(docs.where("false")).count() == 0
    assert N.deduplicated(docs.where("false")).count() == 0
    assert [r.component_id for r in N.linked(docs).collect()] == [1]


def test_components_of_a_path(spark):
    rng = random.Random(2)
    names = rng.sample(range(10_000), 200)
    links = spark.createDataFrame(list(zip(names, names[1:], strict=False)), "a bigint, b bigint")
    labels = {r.node: r.to for r in N.components(links).collect()}
    assert len(labels) == 200 and set(labels.values()) == {min(names)}


def test_pairs_of_a_large_group_grow_with_its_nodes(spark):
    """Nodes that share about half of their 32 buckets with any other, as one large group of near copies does."""
    rng = random.Random(5)
    pairs = {}
    for n in (100, 400):
        rows = [(key, i, i) for i in range(n) for key in range(32) if rng.random() < 0.5]
        found = N.starred(spark.createDataFrame(rows, "key bigint, number bigint, comp bigint"), 0).collect()
        assert {x for r in found for x in r} == set(range(n))
        pairs[n] = len(found)
    assert pairs[400] <= 4 * 400 and pairs[400] <= 4.4 * pairs[100]


def test_components_of_many_stars(spark):
    """Centres that share members; a component's label is its least node, also beside a second component."""
    rng = random.Random(6)
    links = [(c, 1000 + rng.randrange(300)) for c in range(20, 40) for _ in range(60)] + [(5000, 4999), (5000, 5001), (7, 7)]
    labels = {r.node: r.to for r in N.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert labels == {x: 4999 if 4000 < x else 7 if x == 7 else 20 for link in links for x in link}
