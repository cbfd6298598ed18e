"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters, digits and non-ASCII characters, A-Z in lower case, so punctuation and spacing don't
matter. A mask picks six of seven or eight neighbouring tokens; the hash of the picked ones is a seed. Test seeds are
joined with the seeds at every token of every training text, and around each hit text and item are compared on that
diagonal. An overlap is a window of ``WINDOW`` tokens that agree in all but ``SUBSTITUTIONS`` places at most. The
three masks hit every such window (a test goes through all placements), so none is missed.

Items of ``SHORTEST`` to ``WINDOW - 1`` tokens overlap where they occur whole and unchanged; shorter ones never.
Items with equal tokens count as the one with the smallest id. The test set is taken in blocks of about
``BLOCK_BYTES``, each sent to all workers, so what is sent has a fixed size whatever the test set's; every block
meets every training text.

Defined results: null, empty and blank texts and items overlap nothing; an empty test set leaves all documents; a null
item id sorts before others; repeated rows get equal results; the filter keeps all columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.llm import tokens

WINDOW, SUBSTITUTIONS, SHORTEST = 12, 2, 8
MASKS = ("1111011", "11101011", "11001111")
BLOCK_BYTES = 4_000_000
SLICE_BYTES = 1_000_000
FILTER_BITS = 20
OVERLAPS = "array<struct<item_id: bigint, first: bigint, end: bigint>>"


def in_token(data: np.ndarray) -> np.ndarray:
    """Bytes of letters (of lower-cased text), digits and non-ASCII characters."""
    return ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)


def seeds(words: tokens.Words, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of a mask's seeds within texts."""
    at = np.flatnonzero(words.left() >= len(mask))
    factors = tokens.powers(tokens.WORD_BASE, len(mask))
    total = np.zeros(len(at), np.uint64)
    for k, picked in enumerate(mask):
        if picked == "1":
            total += words.hashes[at + k] * factors[k]
    return at, tokens.mixed(total)


@dataclass
class TestSet:
    """A block of items: their tokens' hashes and, for each mask, its seeds in order."""

    ids: list[int | None]
    hashes: np.ndarray
    first: np.ndarray
    seeds: list[tuple[np.ndarray, np.ndarray]]  # hashes, and places in ``hashes``

    @classmethod
    def of(cls, items: list[tuple[int | None, str | None]]) -> TestSet:
        items = sorted(items, key=lambda x: (x[0] is not None, x[0]))
        words = tokens.words(pa.array([t for _, t in items], pa.string()), lower=True, inside=in_token)
        kept, known = [], set()
        for i in range(len(items)):
            own = words.hashes[words.first[i] : words.first[i + 1]]
            if len(own) >= SHORTEST and own.tobytes() not in known:
                known.add(own.tobytes())
                kept.append(i)
        texts = pa.array([items[i][1] for i in kept], pa.string())
        words = tokens.words(texts, lower=True, inside=in_token)
        found = []
        for mask in MASKS:
            at, hashes = seeds(words, mask)
            order = np.argsort(hashes, kind="stable")
            found.append((hashes[order], at[order]))
        return cls([items[i][0] for i in kept], words.hashes, words.first, found)

    def overlaps(self, words: tokens.Words) -> list[tuple[int, int, int, int]]:
        """(text, item, first token, last + 1) of all runs of overlapping windows, in order of text and item."""
        if not len(self.ids):
            return []
        diagonals = [np.zeros((0, 2), np.int64)]
        for mask, (known, places) in zip(MASKS, self.seeds, strict=True):
            at, hashes = seeds(words, mask)
            rare = np.zeros(1 << FILTER_BITS, bool)
            shift = np.uint64(64 - FILTER_BITS)
            rare[(known >> shift).astype(np.int64)] = True
            maybe = np.flatnonzero(rare[(hashes >> shift).astype(np.int64)])
            at, hashes = at[maybe], hashes[maybe]
            low, high = np.searchsorted(known, hashes, "left"), np.searchsorted(known, hashes, "right")
            n = high - low
            hits = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            place = places[hits]
            item = np.searchsorted(self.first, place, "right") - 1
            diagonals.append(np.unique(np.stack((np.repeat(at, n) - place + self.first[item], item), 1), axis=0))
        owner = words.texts()
        out = []
        # a diagonal: where the item's first token would lie, and the item; the text is that of the seed
        for begin, item in np.unique(np.concatenate(diagonals), axis=0).tolist():
            out += self.along(words, owner, begin, item)
        return sorted(set(out))

    def along(self, words: tokens.Words, owner: np.ndarray, begin: int, item: int) -> list[tuple[int, int, int, int]]:
        own = self.hashes[self.first[item] : self.first[item + 1]]
        low, high = max(0, begin), min(len(words.hashes), begin + len(own))
        same = words.hashes[low:high] == own[low - begin : high - begin]
        size, most = (WINDOW, SUBSTITUTIONS) if len(own) >= WINDOW else (len(own), 0)
        if len(same) < size:
            return []
        sums = np.concatenate(([0], np.cumsum(same)))
        starts = np.flatnonzero(sums[size:] - sums[:-size] >= size - most) + low
        starts = starts[owner[starts] == owner[starts + size - 1]]  # within one text
        out: list[tuple[int, int, int, int]] = []
        for start in starts.tolist():
            text = int(owner[start])
            first = start - int(words.first[text])
            if out and out[-1][0] == text and first <= out[-1][3]:
                out[-1] = (*out[-1][:3], first + size)
            else:
                out.append((text, item, first, first + size))
        return out


def blocks(items: DataFrame, text: str = "text", ident: str = "item_id") -> Iterator[TestSet]:
    """The test set, block by block: a block is all that the driver holds at a time."""
    rows = items.select(F.col(ident).alias("id"), F.col(text).alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // BLOCK_BYTES) + 1
    for block in range(n):
        own = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == block)
        yield TestSet.of([(r.id, r.text) for r in own.groupBy("text").agg(F.min("id").alias("id")).collect()])


def overlaps(docs: DataFrame, items: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(id, overlaps) of every document: an array of (item_id, first, end), in tokens of the text.

    Each block appends its overlaps to those of the blocks before it, so documents are never joined."""
    rows = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"), F.array().cast(OVERLAPS).alias("overlaps"))
    kind = rows.schema["id"].dataType.simpleString()
    for block in blocks(items):
        rows = rows.mapInArrow(tokens.releasing(spans(block)), f"id {kind}, text string, overlaps {OVERLAPS}")
    return rows.select("id", "overlaps")


def spans(block: TestSet):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("first", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for batch in tokens.sliced(whole, 1, SLICE_BYTES):
                words = tokens.words(batch.column(1), lower=True, inside=in_token)
                lists = batch.column(2).to_pylist()
                for text, item, first, end in block.overlaps(words):
                    lists[text].append({"item_id": block.ids[item], "first": first, "end": end})
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, kind)], names=["id", "text", "overlaps"])

    return find


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents, all columns, that overlap no item. The blocks are filters behind each other."""
    for block in blocks(items):
        docs = docs.mapInArrow(tokens.releasing(clean(block, docs.columns.index(text))), docs.schema)
    return docs


def clean(block: TestSet, column: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tokens.sliced(whole, column, SLICE_BYTES):
                words = tokens.words(batch.column(column), lower=True, inside=in_token)
                free = np.ones(batch.num_rows, bool)
                free[[text for text, *_ in block.overlaps(words)]] = False
                yield batch.filter(pa.array(free))

    return keep
