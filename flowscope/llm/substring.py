"""Removal of passages that occur more than once, with fixed-block anchors.

A window of ``window`` words always holds a whole block of ``(window + 1) // 2`` words that starts at a multiple of
that number in its text. So the blocks of all texts are the index, and the same-sized windows at every word are the
probes. A hit is a block hash that occurs as a block and at least once more. The windows around hits are the only
ones that can repeat; they are compared as wholes, and the union of those found again is a maximal exact repeat.

Texts are dealt into chunks by a hash of id and text. A chunk sends each hash once, with its number of occurrences
(one or more), so a passage in a third of all texts costs one entry per chunk, not one per text; pairs of texts are
never formed. Both exchanges deal by hash. The chunks lie in a table bucketed by chunk, so the answers meet the texts
without moving them again. Windows are compared by 64-bit hashes beside the number of their bucket.

Defined results: windows are judged on the input, copies in the same text count; null, empty and short texts lose
nothing; rows that repeat an id and text are texts of their own; an empty table gives no rows; further columns are
ignored. Kept words are joined by one space.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.llm import tokens
from flowscope.session import materialized, scratch_path

WINDOW = 35
CHUNK_BYTES = 8_000_000
#: Spark's own bound on the buckets of a table; beyond it a bucket holds several chunks.
MOST_BUCKETS = 100_000

SENT = "bucket bigint, chunk bigint, hashes binary, flags binary"
ANSWERED = "chunk bigint, bucket bigint, hashes binary"
BLOCK, TWICE = 1, 2


def chunked(docs: DataFrame, text: str, ident: str, chunks: int) -> DataFrame:
    """(id, text, chunk), bucketed by chunk."""
    narrow = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    narrow = narrow.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("bigint"))
    name, buckets = f"flowscope_{uuid.uuid4().hex}", min(chunks, MOST_BUCKETS)
    dealt = narrow.repartition(buckets, "chunk").write.bucketBy(buckets, "chunk")
    dealt.option("path", scratch_path(docs.sparkSession, "chunks")).format("parquet").saveAsTable(name)
    return docs.sparkSession.table(name)


def sent(chunk: int, hashes: np.ndarray, flags: np.ndarray, buckets: int, kind: type) -> pa.Table:
    """A chunk's distinct hashes by bucket (from the high half), as rows of ``SENT``; ``kind`` is what is kept of them."""
    order = np.argsort(hashes, kind="stable")
    hashes, flags = hashes[order], flags[order]
    new = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, np.int64)
    counts = np.diff(np.append(new, len(hashes)))
    union = np.bitwise_or.reduceat(flags, new) if len(new) else flags
    union = union | np.where(counts > 1, TWICE, 0).astype(np.uint8)
    hashes = hashes[new]
    bucket = bucket_of(hashes, buckets)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cuts))
    rows = [
        (int(b), tokens.packed(hashes[cuts[b] : cuts[b + 1]].astype(kind)), union[cuts[b] : cuts[b + 1]].tobytes())
        for b in full
    ]
    return pa.table(
        [
            pa.array([r[0] for r in rows], pa.int64()), pa.array([chunk] * len(rows), pa.int64()),
            pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()),
        ],
        names=["bucket", "chunk", "hashes", "flags"],
    )


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def matched(kind: type, needed: int):
    """For a bucket, each chunk's hashes that occur twice or more in all chunks together and have the flags ``needed``
    in one of them."""

    def match(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lists = [tokens.unpacked(x.as_py(), kind) for x in table["hashes"]]
        hashes = np.concatenate(lists)
        flags = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table["flags"]])
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        new = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(np.append(new, len(ordered)))
        union = np.bitwise_or.reduceat(flags[order], new)
        good = ((counts > 1) | (union & TWICE > 0)) & (union & needed == needed)
        found = np.empty(len(hashes), bool)
        found[order] = np.repeat(good, counts)
        chunks, answers, begin = [], [], 0
        for chunk, values in zip(table["chunk"].to_pylist(), lists, strict=True):
            mine = values[found[begin : begin + len(values)]]
            begin += len(values)
            if len(mine):
                chunks.append(chunk)
                answers.append(tokens.packed(mine))
        arrays = [pa.array(chunks, pa.int64()), pa.array([key[0].as_py()] * len(chunks), pa.int64()), pa.array(answers, pa.binary())]
        return pa.table(arrays, names=["chunk", "bucket", "hashes"])

    return match


def answered(table: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and hashes of a chunk's answers, in order."""
    lists = [tokens.unpacked(x.as_py(), kind) for x in table["hashes"]]
    if not lists:
        return np.zeros(0, np.int64), np.zeros(0, kind)
    return np.repeat(np.array(table["bucket"].to_pylist(), np.int64), [len(x) for x in lists]), np.concatenate(lists)


def isin(hashes: np.ndarray, table: pa.Table, buckets: int, kind: type) -> np.ndarray:
    """Which hashes a chunk's answers have."""
    bucket, found = answered(table, kind)
    out = np.zeros(len(hashes), bool)
    if not len(found):
        return out
    if kind is np.uint32:  # bucket and low half together
        keys = (bucket.astype(np.uint64) << np.uint64(32)) | found
        wanted = (bucket_of(hashes, buckets).astype(np.uint64) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))
    else:  # a whole hash gives its bucket
        keys, wanted = found, hashes
    return np.isin(wanted, keys)


def repeated(docs: DataFrame, window: int = WINDOW, text: str = "text", ident: str = "doc_id", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, n_words, n_removed, kept_text, spans): spans are the removed runs of words as (first, last + 1)."""
    block = (window + 1) // 2
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    chunks = buckets = int(total // chunk_bytes) + 1
    table = chunked(docs, text, ident, chunks)

    def probes(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        words = tokens.words(group["text"])
        at, hashes = words.windows(block)
        place = at - words.first[words.texts()[at]]
        return sent(key[0].as_py(), hashes, (place % block == 0).astype(np.uint8) * BLOCK, buckets, np.uint32)

    def around(key: tuple[pa.Scalar, ...], group: pa.Table, hits: pa.Table) -> pa.Table:
        if not len(group):
            return sent(0, np.zeros(0, np.uint64), np.zeros(0, np.uint8), buckets, np.uint64)
        words = tokens.words(group["text"])
        at, hashes = words.windows(block)
        hit = np.zeros(len(words.hashes) + 1, bool)
        hit[at[isin(hashes, hits, buckets, np.uint32)]] = True
        before = np.concatenate(([0], np.cumsum(hit)))
        starts, whole = words.windows(window)
        near = before[np.minimum(starts + window - block + 1, len(hit))] > before[starts]  # a hit inside the window
        whole = whole[near]
        return sent(key[0].as_py(), whole, np.zeros(len(whole), np.uint8), buckets, np.uint64)

    def cut(key: tuple[pa.Scalar, ...], group: pa.Table, again: pa.Table) -> pa.Table:
        ids, n_words, n_removed, kept, spans = [], [], [], [], []
        words = tokens.words(group["text"])
        starts, whole = words.windows(window)
        change = np.zeros(len(words.hashes) + 1, np.int32)
        found = starts[isin(whole, again, buckets, np.uint64)]
        np.add.at(change, found, 1)
        np.add.at(change, found + window, -1)
        covered = np.cumsum(change[:-1]) > 0
        for i in range(len(words.first) - 1):
            a, b = int(words.first[i]), int(words.first[i + 1])
            gone = covered[a:b]
            n_words.append(b - a)
            n_removed.append(int(gone.sum()))
            stay = np.flatnonzero(~gone) + a
            kept.append(b" ".join(words.data[s:e].tobytes() for s, e in zip(words.starts[stay].tolist(), words.ends[stay].tolist(), strict=True)))
            edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).tolist()
            spans.append([{"first": f, "end": e} for f, e in zip(edges[::2], edges[1::2], strict=True)])
        span = pa.struct([("first", pa.int64()), ("end", pa.int64())])
        return pa.table(
            [
                group["id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(span)),
            ],
            names=["id", "n_words", "n_removed", "kept_text", "spans"],
        )

    texts = table.groupBy("chunk")
    hits = texts.applyInArrow(probes, SENT).groupBy("bucket").applyInArrow(matched(np.uint32, BLOCK), ANSWERED)
    wide = texts.cogroup(hits.groupBy("chunk")).applyInArrow(around, SENT)
    again = materialized(wide.groupBy("bucket").applyInArrow(matched(np.uint64, 0), ANSWERED), "again")
    kind = table.schema["id"].dataType.simpleString()
    spans = "spans array<struct<first: bigint, end: bigint>>"
    return texts.cogroup(again.groupBy("chunk")).applyInArrow(cut, f"id {kind}, n_words bigint, n_removed bigint, kept_text string, {spans}")
