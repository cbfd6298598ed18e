"""Byte-level BPE encoding and decoding with a pair occurrence index.

A worker cuts its texts into units that no pre-token crosses (at a space behind a non-space), so equal units have equal
ids everywhere. The new units of a batch lie behind each other in one symbol array, with an index from each pair's
rank to all its positions in that array. The active ranks are applied in ascending order; applying one merges all its positions
at once and moves only the affected neighbours to the lists of their new ranks. A text's ids are gathered from its
units. What earlier batches of a task encoded is kept up to ``KEPT_UNITS`` units; that changes speed, not results.

The vocabulary is read on the driver from a path that is a parameter, and has a fixed size.

Defined results: null and empty texts have no tokens and decode to the empty text; texts are processed whole,
whatever their length; the strings of added tokens in a text become those tokens; repeated rows get equal results;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.llm.tokens import releasing

KEPT_UNITS = 300_000
#: Symbols that are merged in one array, and bytes of text whose new units are merged together.
ARRAY_SYMBOLS = 1_000_000
BATCH_BYTES = 2_000_000

#: White space in the sense of the pre-tokenizer, and its pattern.
SPACE = " \t\n\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^W\p{L}\p{N}]+|[W]+(?![^W])|[W]+".replace("W", SPACE)
NO_RANK = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable bytes for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tables of a tokenizer file: merges by rank, and the bytes of every id."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, ids = byte_letters(), spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_ids = np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.byte_ids[byte] = ids[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([(ids[a] << 32) | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.left = np.array([ids[a] for a, _ in pairs], np.int32)
        self.right = np.array([ids[b] for _, b in pairs], np.int32)
        tokens = {i: bytes(letters[c] for c in token) for token, i in ids.items()}
        tokens |= {i: content.encode() for content, i in self.added.items()}
        self.token_sizes = np.array([len(tokens.get(i, b"")) for i in range(max(tokens) + 1)], np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.token_bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(len(self.token_sizes))), np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_RANK)


class Occurrences:
    """Positions of each rank's pair; positions that a later merge took are skipped when the rank's turn comes."""

    def __init__(self) -> None:
        self.lists: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []

    def add(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        known = ranks != NO_RANK
        ranks, positions = ranks[known], positions[known]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist(), len(ranks)]
        for rank, a, b in zip(ranks[starts[:-1]].tolist(), starts, starts[1:], strict=False):
            if rank in self.lists:
                self.lists[rank].append(positions[a:b])
            else:
                self.lists[rank] = [positions[a:b]]
                heapq.heappush(self.active, rank)

    def next(self) -> tuple[int, np.ndarray]:
        rank = heapq.heappop(self.active)
        lists = self.lists.pop(rank)
        return rank, np.unique(np.concatenate(lists) if len(lists) > 1 else lists[0])


def apart(positions: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For a pair of equal symbols: every other position of each run of overlapping pairs, from the left."""
    follows = np.concatenate(([False], positions[1:] == after[positions[:-1]]))
    number = np.arange(len(positions))
    start = np.maximum.accumulate(np.where(follows, 0, number))
    return positions[(number - start) % 2 == 0]


def merge(symbols: np.ndarray, last: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Apply all merges inside pre-tokens; ``last`` marks the last symbol of each. Returns the symbols and which stay."""
    n = len(symbols)
    place = np.arange(n, dtype=np.int32)
    after = np.where(last, -1, place + 1).astype(np.int32)
    before = np.where(np.concatenate(([True], last[:-1])), -1, place - 1).astype(np.int32)
    stays = np.ones(n, bool)
    index = Occurrences()
    open_ = np.flatnonzero(~last).astype(np.int32)
    index.add(vocabulary.ranks(symbols[open_], symbols[open_ + 1]), open_)
    while index.active:
        rank, at = index.next()
        left, right = vocabulary.left[rank], vocabulary.right[rank]
        at = at[stays[at] & (symbols[at] == left) & (after[at] >= 0)]
        at = at[symbols[after[at]] == right]
        if left == right:
            at = apart(at, after)
        if not len(at):
            continue
        gone = after[at]
        beyond = after[gone]
        symbols[at] = vocabulary.merged[rank]
        stays[gone] = False
        after[at] = beyond
        inner = beyond >= 0
        before[beyond[inner]] = at[inner]
        ahead = before[at]
        ahead = ahead[ahead >= 0]
        changed = np.concatenate((ahead, at[inner]))
        index.add(vocabulary.ranks(symbols[changed], symbols[after[changed]]), changed)
    return symbols, stays


class Encoder:
    """Ids of texts, and texts of ids, in a worker."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.pattern = regex.compile(PATTERN)
        added = sorted(vocabulary.added, key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.forget()

    def forget(self) -> None:
        #: Unit number by text, for units at the start of a segment and for those with a space before them.
        self.first: dict[str, int] = {}
        self.rest: dict[str, int] = {}
        self.new: list[str] = []
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, text: str) -> list[int]:
        """Unit numbers of a text. An added token is the unit with its negative id less one."""
        if self.added is None or not any(content in text for content in self.vocabulary.added):
            return self.segment(text)
        out: list[int] = []
        for i, part in enumerate(self.added.split(text)):
            out += [-1 - self.vocabulary.added[part]] if i % 2 else self.segment(part)
        return out

    def segment(self, text: str) -> list[int]:
        if not text:
            return []
        units = text.split(" ")
        if text[0] == " " or any(space + " " in text for space in (SPACE[:6] if text.isascii() else SPACE)):
            units = self.joined(units)
        number = self.first.get(units[0])
        if number is None:
            number = self.first[units[0]] = len(self.starts) + len(self.new)
            self.new.append(units[0])
        rest = self.rest
        out = [number]
        try:
            out += [rest[u] for u in units[1:]]
        except KeyError:
            for u in units[1:]:
                if u not in rest:
                    rest[u] = len(self.starts) + len(self.new)
                    self.new.append(" " + u)
            out += [rest[u] for u in units[1:]]
        return out

    @staticmethod
    def joined(parts: list[str]) -> list[str]:
        """Parts between spaces, joined where white space or nothing is before the space."""
        out: list[list[str]] = [[parts[0]]]
        for before, part in zip(parts, parts[1:], strict=False):
            if before == "" or before[-1] in SPACE:
                out[-1].append(part)
            else:
                out.append([part])
        return [" ".join(x) for x in out]

    def learn(self) -> None:
        """Encode the units that were new."""
        units, self.new = self.new, []
        while units:
            size, count = 0, 0
            while count < len(units) and (count == 0 or size + 4 * len(units[count]) <= ARRAY_SYMBOLS):
                size += len(units[count].encode())
                count += 1
            self.encode_units(units[:count])
            units = units[count:]

    def encode_units(self, units: Sequence[str]) -> None:
        pieces, counts = [], np.zeros(len(units), np.int64)
        for i, unit in enumerate(units):
            found = self.pattern.findall(unit)
            counts[i] = len(found)
            pieces += found
        coded = [p.encode() for p in pieces]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        symbols = self.vocabulary.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(sizes) - 1] = True
        symbols, stays = merge(symbols, last, self.vocabulary)
        unit_ends = np.cumsum(sizes)[np.cumsum(counts) - 1]
        left = np.concatenate(([0], np.cumsum(stays)))
        ends = left[unit_ends]
        starts = np.concatenate(([0], ends[:-1]))
        self.starts = np.concatenate((self.starts, starts + len(self.ids)))
        self.sizes = np.concatenate((self.sizes, ends - starts))
        self.ids = np.concatenate((self.ids, symbols[stays].astype(np.int32)))

    def encode(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        """Ids of each text, as unsigned 32-bit integers."""
        if len(self.first) + len(self.rest) > KEPT_UNITS:
            self.forget()
        numbers = [np.array(self.numbers(t), np.int32) for t in texts]
        self.learn()
        for found in numbers:
            if not len(found):
                yield np.zeros(0, np.uint32)
            elif found.min() >= 0:
                yield self.gathered(found)
            else:
                special = np.flatnonzero(found < 0)
                parts, begin = [], 0
                for i in special.tolist():
                    parts += [self.gathered(found[begin:i]), np.array([-1 - found[i]], np.uint32)]
                    begin = i + 1
                yield np.concatenate([*parts, self.gathered(found[begin:])])

    def gathered(self, numbers: np.ndarray) -> np.ndarray:
        if not len(numbers):
            return np.zeros(0, np.uint32)
        return self.ids[spread(self.starts[numbers], self.sizes[numbers])].astype(np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        v = self.vocabulary
        at = spread(v.token_starts[ids], v.token_sizes[ids])
        return v.token_bytes[at].tobytes().decode("utf-8", "replace")


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of ranges, one range after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """The ``keep`` columns with n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers),
    decoded_sha256 (of the text that the ids decode to) and, if wanted, ids (array<int>)."""
    narrow = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    width = len(keep)
    names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for whole in batches:
            for batch in bounded(whole, width):
                counts, hashes, texts, lists = [], [], [], []
                for found in encoder.encode(batch.column(width).to_pylist()):
                    counts.append(len(found))
                    hashes.append(hashlib.sha256(found.astype("<u4").tobytes()).hexdigest())
                    texts.append(hashlib.sha256(encoder.decode(found).encode()).hexdigest())
                    if ids:
                        lists.append(found.astype(np.int32))
                columns = [pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())]
                if ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *columns], names=names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:width]]
    fields += ["n_tokens bigint", "ids_sha256 string", "decoded_sha256 string", *["ids array<int>"] * ids]
    return narrow.mapInArrow(releasing(coded), ", ".join(fields))


def bounded(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most BATCH_BYTES of text, or one row."""
    sizes = np.asarray(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), np.int64)
    begin = size = 0
    for i, s in enumerate(sizes.tolist()):
        if i > begin and size + s > BATCH_BYTES:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += s
    if len(sizes) > begin:
        yield batch.slice(begin)


def decode(coded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with the decoded text; null ids decode to the empty text."""
    width = len(keep)
    narrow = coded.select(*keep, ids)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            lists = (np.array(x.as_py() or [], np.int64) for x in batch.column(width))
            text = pa.array([encoder.decode(x) for x in lists], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], text], names=[*keep, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:width])
    return narrow.mapInArrow(texts, f"{fields}, text string")
