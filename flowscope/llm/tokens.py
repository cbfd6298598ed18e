"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A text's words are its runs of non-separators (space and the bytes 9 to 13), found on the UTF-8 bytes. A word's hash
is a polynomial over its bytes modulo 2**64, taken from prefix sums and mixed, so it costs the same for words of any length;
a window's hash is made of its words' hashes in the same way.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once; a longer text is hashed alone.
SLICE_BYTES = 1_000_000
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xD1342543DE82EF95)

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo 2**64."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if len(known) <= 2 * SLICE_BYTES:
            _powers[int(base)] = known
    return known[:n]


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit value spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray | int, base: np.uint64) -> np.ndarray:
    """Hash of each range of ``values``, the same wherever the range lies."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(base, n), out=sums[1:])
    found = (sums[starts + sizes] - sums[starts]) * powers(inverse(base), n + 1)[starts]
    return mixed(found + np.asarray(sizes, np.uint64) * np.uint64(0x2545F4914F6CDD1D))


@dataclass
class Words:
    """Words of several texts: byte places in ``data``, and of each text the number of its first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # one more than texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def left(self) -> np.ndarray:
        """How many words there are from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.hashes))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts (as word numbers) and hashes of all windows of ``n`` words within a text."""
        at = np.flatnonzero(self.left() >= n)
        return at, ranged(self.hashes, at, n, WORD_BASE)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null is the empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[places[0] : places[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return data, places - places[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))


def in_word(data: np.ndarray) -> np.ndarray:
    return (data != 32) & ((data < 9) | (data > 13))


def split(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Words of texts at ``offsets`` of ``data``; ``inside`` marks the bytes of words."""
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = ranged(data, starts, stops - starts, BYTE_BASE)
    return Words(data, starts, stops, hashes, np.searchsorted(starts, offsets))


def words(texts: pa.Array, lower: bool = False, inside=in_word) -> Words:
    """Words of an array of texts, hashed slice by slice so that the working space stays small."""
    data, offsets = raw(texts)
    if lower:
        data = lowered(data)
    parts, begin = [], 0
    while begin < len(offsets) - 1:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + SLICE_BYTES, "right")) - 1)
        low, high = offsets[begin], offsets[end]
        part = data[low:high]
        parts.append((low, split(part, offsets[begin : end + 1] - low, inside(part))))
        begin = end
    if not parts:
        empty = np.zeros(0, np.int64)
        return Words(data, empty, empty, np.zeros(0, np.uint64), np.zeros(1, np.int64))
    firsts, n = [np.zeros(1, np.int64)], 0
    for _, part in parts:
        firsts.append(part.first[1:] + n)
        n += len(part.hashes)
    return Words(
        data,
        np.concatenate([p.starts + low for low, p in parts]),
        np.concatenate([p.ends + low for low, p in parts]),
        np.concatenate([p.hashes for _, p in parts]),
        np.concatenate(firsts),
    )


def release() -> None:
    """Give memory that is free back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work`` on batches; at its end, memory that is free goes back to the system, as workers are kept for later tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def sliced(batch: pa.RecordBatch, column: int | str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(sizes)))
    begin = 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + most, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def packed(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as differences, byte plane by byte plane: the high planes of small differences are
    zeros, which the shuffle's compression removes."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(len(steps), steps.dtype.itemsize).T).tobytes()


def unpacked(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)
