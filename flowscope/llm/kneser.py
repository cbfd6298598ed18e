"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by the workers that score.

Tokens are words (A-Z in lower case) and one end per text; the first token's context is a start mark. Three exchanges
build the model, each of distinct items with their counts, pre-aggregated on every task:

1. word hashes, dealt by hash range: each bucket writes its sorted hashes and counts; a word's id is its place.
2. pairs of ids, dealt by the context's bucket: each bucket writes its sorted pairs and counts, and for each of its contexts how
   many pairs occur once, twice, or more often. Contexts that fill a quarter of an average bucket (so at most
   ``4 * buckets`` of them) are dealt by the pair instead; their figures are added up on the driver.
3. continuation counts (distinct contexts of each word), dealt by the word's bucket.

The lookups of a worker are sorted, so it walks each array once per slice of text, and only touched pages are read.
The model grows with the corpus: all words and pairs are in it. With ids of 32 bits, more than 2**32 - 2 distinct
words raise an error.

Defined results: null and empty texts are one end token; without training rows N and V are 0, nothing is known and
every token has probability 1; repeated rows are counted as often as they occur and get equal scores; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.llm import tokens
from flowscope.llm.shared import mapped, put
from flowscope.llm.substring import bucket_of
from flowscope.session import materialized, scratch_path

SLICE_BYTES = 2_000_000
BUCKET_BYTES = 4_000_000
END = np.uint64(0x0123456789ABCDEF)
LOW = np.uint64(0xFFFFFFFF)
HALF = np.uint64(32)

COUNTED = "bucket bigint, items binary, counts binary"
WRITTEN = "bucket bigint, name string, size bigint, total bigint, tallies array<bigint>, hot array<bigint>, items binary, counts binary"
SCHEMA = pa.schema([
    ("bucket", pa.int64()), ("name", pa.string()), ("size", pa.int64()), ("total", pa.int64()), ("tallies", pa.list_(pa.int64())),
    ("hot", pa.list_(pa.int64())), ("items", pa.binary()), ("counts", pa.binary()),
])


def counted(items: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct items in order, and their numbers or the sums of their counts."""
    if counts is None:
        return np.unique(items, return_counts=True)
    order = np.argsort(items, kind="stable")
    items = items[order]
    new = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1])))[: len(items)]
    return items[new], np.add.reduceat(counts[order], new) if len(new) else counts


def dealt(bucket: np.ndarray, items: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Rows of ``COUNTED``, one for each bucket; ``items`` must be in order."""
    order = np.argsort(bucket, kind="stable")
    bucket, items, counts = bucket[order], items[order], counts[order]
    begins = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))[: len(bucket)].tolist()
    ends = [*begins[1:], len(bucket)]
    lists = [tokens.packed(items[a:b]) for a, b in zip(begins, ends, strict=False)]
    numbers = [planes(counts[a:b]) for a, b in zip(begins, ends, strict=False)]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[begins].astype(np.int64)), pa.array(lists, pa.binary()), pa.array(numbers, pa.binary())], names=["bucket", "items", "counts"]
    )


def planes(counts: np.ndarray) -> bytes:
    return np.ascontiguousarray(counts.astype(np.int64).view(np.uint8).reshape(len(counts), 8).T).tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    items = np.concatenate([tokens.unpacked(x.as_py(), np.uint64) for x in table["items"]])
    return counted(items, np.concatenate([unplaned(x.as_py()) for x in table["counts"]]))


def tallies(counts: np.ndarray) -> list[int]:
    """How many counts are one, two, three, four."""
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def discounts(n: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, each between zero and its count."""
    base = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    made = [k - (k + 1) * base * n[k] / n[k - 1] if n[k - 1] else 0.0 for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(d, 0.0), float(k)) for k, d in enumerate(made, 1))])


@dataclass
class Vocabulary:
    """Words by hash, in buckets."""

    folder: str
    buckets: int
    names: list[str | None]
    offsets: np.ndarray  # the first id of each bucket, and V
    total: int  # N
    hot: np.ndarray  # ids of contexts that are dealt by the pair, in order; the start mark is one

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "files"}

    @property
    def size(self) -> int:
        return int(self.offsets[-1])

    def bucket(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes and counts of a bucket."""
        files = self.__dict__.setdefault("files", {})
        if b not in files:
            n = int(self.offsets[b + 1] - self.offsets[b])
            data = mapped(self.folder, self.names[b]) if n else np.zeros(0, np.uint8)
            files[b] = data[: 8 * n].view(np.uint64), data[8 * n : 16 * n].view(np.int64)
        return files[b]

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts."""
        distinct, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64)
        cuts = np.searchsorted(bucket_of(distinct, self.buckets), np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            known, numbers = self.bucket(b)
            if not len(known):
                continue
            part = distinct[cuts[b] : cuts[b + 1]]
            at = np.minimum(np.searchsorted(known, part), len(known) - 1)
            hit = np.flatnonzero(known[at] == part)
            ids[cuts[b] + hit] = at[hit] + self.offsets[b]
            counts[cuts[b] + hit] = numbers[at[hit]]
        return ids[back], counts[back]

    def pair_buckets(self, pairs: np.ndarray) -> np.ndarray:
        context = (pairs >> HALF).astype(np.int64)
        own = np.searchsorted(self.offsets[1:-1], context, "right")
        spread = bucket_of(tokens.mixed(pairs), self.buckets)
        at = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
        return np.where(self.hot[at] == context, spread, own)


def sequences(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, one text after the other with its end, and the place behind each text's end."""
    words = tokens.words(batch.column(column), lower=True)
    ends = words.first[1:] + np.arange(1, len(words.first))
    out = np.full(int(ends[-1]) if len(ends) else 0, END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[ends - 1] = False
    out[inner] = words.hashes
    return out, ends


def contexts(ids: np.ndarray, ends: np.ndarray, start: int) -> np.ndarray:
    before = np.concatenate(([start], ids[:-1]))
    before[ends[:-1]] = start
    return before


def vocabulary(texts: DataFrame, folder: str, buckets: int) -> Vocabulary:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tokens.sliced(whole, 0, SLICE_BYTES):
                items, numbers = counted(sequences(batch, 0)[0])
                yield dealt(bucket_of(items, buckets), items, numbers)

    def write(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        items, numbers = gathered(table)
        name = put(folder, items, numbers)
        return pa.table([[key[0].as_py()], [name], [len(items)], [int(numbers.sum())], [None], [None], [None], [None]], schema=SCHEMA)

    made = texts.mapInArrow(tokens.releasing(count), COUNTED).groupBy("bucket").applyInArrow(write, WRITTEN)
    made = materialized(made, "words")
    total = made.agg(F.sum("total")).first()[0] or 0
    rows = made.select("bucket", "name", "size").collect()  # one for each bucket
    names, sizes = [None] * buckets, np.zeros(buckets + 1, np.int64)
    for row in rows:
        names[row.bucket], sizes[row.bucket + 1] = row.name, row.size
    offsets = np.cumsum(sizes)
    if offsets[-1] >= 2**32 - 2:
        raise ValueError("more distinct words than 32-bit ids")

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, name, n in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                counts = mapped(folder, name)[8 * n :].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(counts * 4 * buckets > total) + offsets[b])], names=["id"])

    # fewer than 4 * buckets, as their counts add up to the total at most
    found = made.select("bucket", "name", "size").mapInArrow(heavy, "id bigint").collect()
    hot = np.sort(np.array([r.id for r in found] + [offsets[-1]], np.int64))
    return Vocabulary(folder, buckets, names, offsets, int(total), hot)


@dataclass
class Model:
    words: Vocabulary
    names: list[str | None]
    sizes: list[int]
    continued: list[str | None]
    hot_tallies: np.ndarray  # of each hot context: pairs that occur once, twice, more often
    starts: int  # training texts
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    n_pairs: int
    word_tallies: np.ndarray

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "files"}

    def bucket(self, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs and their counts; the tallies of the bucket's contexts; the continuation counts of its words."""
        files = self.__dict__.setdefault("files", {})
        if b not in files:
            n, v = self.sizes[b], int(self.words.offsets[b + 1] - self.words.offsets[b])
            empty = np.zeros(0, np.uint8)
            data = mapped(self.words.folder, self.names[b]) if self.names[b] else empty
            more = mapped(self.words.folder, self.continued[b]) if self.continued[b] else np.zeros(8 * v, np.uint8)
            figures = data[12 * n :].view(np.uint32).reshape(-1, 3) if self.names[b] else np.zeros((v, 3), np.uint32)
            files[b] = data[: 8 * n].view(np.uint64), data[8 * n : 12 * n].view(np.uint32), figures, more.view(np.int64)
        return files[b]

    def log10(self, ids: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Logarithm of each token's probability after the token before it."""
        words = self.words
        if not words.size:
            return np.zeros(len(ids))
        before = contexts(ids, ends, words.size)
        context_count = np.concatenate(([0], counts[:-1]))
        context_count[np.concatenate(([0], ends[:-1]))] = self.starts
        low = self.lowest(ids)
        number, rest = self.pair_parts(before, ids)
        seen = (before >= 0) & (context_count > 0)
        total = np.where(seen, context_count, 1)
        own = (number - self.pair_discounts[np.minimum(number, 3)]) / total
        weight = np.where(seen, rest @ self.pair_discounts[1:] / total, 1.0)
        return np.log10(np.where(seen, own, 0.0) + weight * low)

    def lowest(self, ids: np.ndarray) -> np.ndarray:
        """Continuation probability, interpolated with the uniform one over the words and one unknown."""
        distinct, back = np.unique(ids, return_inverse=True)
        number = np.zeros(len(distinct), np.int64)
        cuts = np.searchsorted(distinct, self.words.offsets)
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            part = distinct[cuts[b] : cuts[b + 1]]
            number[cuts[b] : cuts[b + 1]] = self.bucket(b)[3][part - self.words.offsets[b]]
        spare = self.word_tallies @ self.word_discounts[1:] / self.n_pairs
        found = (number - self.word_discounts[np.minimum(number, 3)]) / self.n_pairs
        return (found + spare / (self.words.size + 1))[back]

    def pair_parts(self, before: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the pairs, and of each context the tallies of its pairs."""
        words = self.words
        pairs = (np.maximum(before, 0).astype(np.uint64) << HALF) | np.maximum(ids, 0).astype(np.uint64)
        distinct, back = np.unique(pairs, return_inverse=True)
        bucket = words.pair_buckets(distinct)
        context = (distinct >> HALF).astype(np.int64)
        number, rest = np.zeros(len(distinct), np.int64), np.zeros((len(distinct), 3), np.int64)
        at_hot = np.minimum(np.searchsorted(words.hot, context), len(words.hot) - 1)
        hot = words.hot[at_hot] == context
        rest[hot] = self.hot_tallies[at_hot[hot]]
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(words.buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            mine = order[cuts[b] : cuts[b + 1]]
            known, counts, figures, _ = self.bucket(b)
            if len(known):
                at = np.minimum(np.searchsorted(known, distinct[mine]), len(known) - 1)
                number[mine] = np.where(known[at] == distinct[mine], counts[at], 0)
            usual = mine[~hot[mine]]
            rest[usual] = figures[context[usual] - words.offsets[b]]
        known = ((before >= 0) & (ids >= 0))
        return np.where(known, number[back], 0), rest[back]


def learned(docs: DataFrame, text: str = "text") -> Model:
    """The model of all texts of ``docs``."""
    spark, texts = docs.sparkSession, docs.select(F.col(text).alias("text"))
    size, n = texts.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    buckets = int((size or 0) // BUCKET_BYTES) + 1
    folder = scratch_path(spark, "model")
    words = vocabulary(texts, folder, buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tokens.sliced(whole, 0, SLICE_BYTES):
                hashes, ends = sequences(batch, 0)
                ids, _ = words.look_up(hashes)
                pairs = (contexts(ids, ends, words.size).astype(np.uint64) << HALF) | ids.astype(np.uint64)
                items, numbers = counted(pairs)
                yield dealt(words.pair_buckets(items), items, numbers)

    def write(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b = key[0].as_py()
        items, numbers = gathered(table)
        context = (items >> HALF).astype(np.int64)
        at = np.minimum(np.searchsorted(words.hot, context), len(words.hot) - 1)
        hot = words.hot[at] == context
        kind = np.minimum(numbers, 3) - 1
        figures = np.zeros((int(words.offsets[b + 1] - words.offsets[b]), 3), np.uint32)
        np.add.at(figures, (context[~hot] - words.offsets[b], kind[~hot]), 1)
        name = put(folder, items, np.minimum(numbers, 2**32 - 1).astype(np.uint32), figures)
        places, found = counted(at[hot] * 3 + kind[hot])
        spread = np.stack((places, found), 1).ravel().tolist()
        out = [pa.table([[b], [name], [len(items)], [int(numbers.sum())], [tallies(numbers)], [spread], [None], [None]], schema=SCHEMA)]
        followers, distinct = counted(items & LOW)
        rows = dealt(np.searchsorted(words.offsets[1:-1], followers.astype(np.int64), "right"), followers, distinct)
        none = [None] * len(rows)
        out.append(pa.table([rows["bucket"], none, none, none, none, none, rows["items"], rows["counts"]], schema=SCHEMA))
        return pa.concat_tables(out)

    def continued(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b = key[0].as_py()
        items, numbers = gathered(table)
        dense = np.zeros(int(words.offsets[b + 1] - words.offsets[b]), np.int64)
        dense[items.astype(np.int64) - words.offsets[b]] = numbers
        name = put(folder, dense)
        # of the words with three and more, all
        counts = [*tallies(numbers), int((numbers >= 3).sum())]
        return pa.table([[b], [name], [len(items)], [int(numbers.sum())], [counts], [None], [None], [None]], schema=SCHEMA)

    made = texts.mapInArrow(tokens.releasing(count), COUNTED).groupBy("bucket").applyInArrow(write, WRITTEN)
    made = materialized(made, "pairs")
    files = made.where("name is not null").drop("items", "counts", "hot").collect()  # one for each bucket
    names, sizes = [None] * buckets, [0] * buckets
    for row in files:
        names[row.bucket], sizes[row.bucket] = row.name, row.size
    spread = made.where("name is not null").select("bucket", F.posexplode("hot").alias("at", "value"))
    spread = spread.groupBy("bucket", F.floor(F.col("at") / 2).alias("n")).agg(F.min_by("value", "at").alias("place"), F.max_by("value", "at").alias("found"))
    hot = np.zeros(3 * len(words.hot), np.int64)
    for row in spread.groupBy("place").agg(F.sum("found").alias("found")).collect():  # at most three for each hot context
        hot[row.place] = row.found
    ends = made.where("name is null").select("bucket", "items", "counts").groupBy("bucket").applyInArrow(continued, WRITTEN)
    ends = materialized(ends.drop("items", "counts", "hot"), "continued").collect()  # one for each bucket
    places: list[str | None] = [None] * buckets
    for row in ends:
        places[row.bucket] = row.name
    n_counts = [sum(r.tallies[k] for r in files) for k in range(4)]
    m_counts = [sum(r.tallies[k] for r in ends) for k in range(5)]
    return Model(
        words, names, sizes, places, hot.reshape(-1, 3), int(n), discounts(n_counts), discounts(m_counts),
        sum(sizes), np.array([m_counts[0], m_counts[1], m_counts[4]]),
    )


def scored(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with n_tokens, n_known, train_tokens, base_score (unigrams with one added to each count),
    score (log10 of the model's probability) and perplexity (per token)."""
    width = len(keep)
    narrow = docs.select(*keep, F.col(text).alias("__text"))
    words = model.words

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tokens.sliced(whole, width, SLICE_BYTES):
                hashes, ends = sequences(batch, width)
                ids, counts = words.look_up(hashes)
                begins = np.concatenate(([0], ends[:-1]))
                n = ends - begins
                base = np.log10((counts + 1) / (words.total + words.size + 1))
                logs = model.log10(ids, counts, ends)
                sums = [np.add.reduceat(x, begins) for x in ((counts > 0).astype(np.int64), base, logs)]
                added = [
                    ("n_tokens", n), ("n_known", sums[0]), ("train_tokens", np.full(len(n), words.total)), ("base_score", sums[1]),
                    ("score", sums[2]), ("perplexity", 10 ** (-sums[2] / n)),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *(pa.array(v) for _, v in added)], names=[*keep, *(k for k, _ in added)])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:width]]
    fields += ["n_tokens bigint", "n_known bigint", "train_tokens bigint", "base_score double", "score double", "perplexity double"]
    return narrow.mapInArrow(tokens.releasing(score), ", ".join(fields))
