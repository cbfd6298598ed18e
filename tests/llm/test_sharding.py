import hashlib
import random
import zlib

import pytest

from flowscope.llm import sharding as S


def key(text, ident):
    digits = hashlib.md5((text or "").encode()).hexdigest()[:8] + hashlib.md5(("" if ident is None else str(ident)).encode()).hexdigest()[:7]
    return int(digits, 16)


def expected(rows, shards):
    """{(id, text): shard}: the shard holds the share of bytes below the row's key."""
    sizes = sorted((key(t, i), len((t or "").encode()) + 1, i, t) for i, t in rows)
    total, below, out, at = sum(s for _, s, _, _ in sizes), 0, {}, 0
    while at < len(sizes):
        same = [x for x in sizes if x[0] == sizes[at][0]]
        for _, _, i, t in same:
            out[i, t] = min(shards - 1, shards * below // total)
        below, at = below + sum(x[1] for x in same), at + len(same)
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, size int, Shard string")


def check(spark, rows, shards=4):
    found = S.shard_rows(table(spark, rows), shards).collect()
    text = dict(rows)
    want = expected(rows, shards)
    assert sorted((r.id is not None, r.id) for r in found) == sorted((i is not None, i) for i, _ in rows)
    for r in found:
        t = text[r.id]
        assert r.size == len((t or "").encode()) + 1
        assert r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
        assert r.shard == want[r.id, t]
    for shard in range(shards):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_shares_of_bytes(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["", None, "é" * rng.randint(0, 50), "x" * rng.randint(0, 2000)])) for i in range(400)]
    check(spark, rows)


def test_hot_text_and_long_text(spark):
    check(spark, [(i, "same text" if i % 3 else f"text {i}") for i in range(600)] + [(-1, "y" * 30_000), (None, "n")])


def test_repeated_rows_fill_shards_evenly(spark):
    rows = [(1, "a"), (1, "a"), (1, "a"), (2, "b"), (3, "c"), (1, "a")]
    found = S.shard_rows(table(spark, rows), 3).collect()
    assert sorted(r.shard for r in found) == [0, 0, 1, 1, 2, 2]


def test_empty(spark):
    assert S.shard_rows(table(spark, [(1, "a")]).where("false"), 8).count() == 0


@pytest.mark.parametrize("steps", [2, 7, 256])
def test_tolerance(spark, steps):
    docs = table(spark, [(i, f"text {i}" * (i % 9)) for i in range(500)])
    keyed = docs.selectExpr("*").withColumn("k", S.sort_key("text", "doc_id")).selectExpr("k", "octet_length(text) + 1 w").cache()
    exact, rough = S.splitters(keyed, "k", "w", 5, 0.0, steps), S.splitters(keyed, "k", "w", 5, 0.2, steps)
    total = keyed.agg({"w": "sum"}).first()[0]
    for i, (a, b) in enumerate(zip(exact, rough, strict=True), 1):
        below = keyed.where(f"k < {b.boundary}").agg({"w": "sum"}).first()[0] or 0
        assert abs(below - i * total / 5) <= 0.2 * total / 5 + 50
        assert keyed.where(f"k < {a.boundary}").agg({"w": "sum"}).first()[0] * 5 >= i * total


def test_written(spark, tmp_path):
    docs = table(spark, [(i, f"text {i}") for i in range(100)]).drop("Shard")
    S.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    got = {r.doc_id: r.shard for r in back.collect()}
    assert got == {r.id: r.shard for r in S.shard_rows(docs, 4).collect()}


def test_rows_that_repeat_id_and_text_are_split(spark):
    rows = [(None, "hot text")] * 600 + [(i, "cold text number") for i in range(400)] + [(7, None)] * 50
    found = S.shard_rows(table(spark, rows), 4).collect()
    assert len(found) == len(rows)
    total = sum(r.size for r in found)
    for shard in range(4):
        own = [r for r in found if r.shard == shard]
        assert abs(sum(r.size for r in own) - total / 4) <= 18
        assert sorted(r.slot for r in own) == list(range(len(own)))
    alone = S.shard_rows(table(spark, [(1, "x")] * 80), 8).collect()
    assert sorted((r.shard, r.slot) for r in alone) == [(s, i) for s in range(8) for i in range(10)]
