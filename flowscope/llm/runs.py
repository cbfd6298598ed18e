"""Runs of repeated words by an online sparse dynamic programme over diagonals.

Diagonal q of a text matches at word i if words i and i - q are equal. A run of smallest period q is a maximal stretch
of matches on diagonal q with the q words before it, so finding runs means following match lengths of active lags. To
follow the lag of every earlier occurrence of every word would cost the square of a frequent word's count, but no lag
q can end in a run of ``least`` words and ``cycles`` periods unless whole windows of words recur at that distance.
Therefore an occurrence of a word opens a lag only together with the words behind it:

* lags under 16 by windows of 8 words, lags from c to 2c by windows of c = 16, 32, ... words;
* of a window's earlier occurrences only the three nearest. A window whose smallest period is over c/2 occurs at
  distances over c/2, so three occurrences reach back 2c words; and every run of a lag in the class has such a window
  at every multiple of the lag, as otherwise its windows, which overlap by c - 1 words, would all have one period of c/2
  at most, and so would the run. (For lags up to 4 the nearest occurrence is the lag itself.)

So a class opens at most three lags a word, whatever the text. An open lag is followed word by word until two words
differ; then it ends and emits its run at once if that is long enough. Occurrences on a lag that is still open only
continue it. Words are compared by numbers that stand for the exact words, so hash collisions of windows cost time
only. A stretch with period q also has the multiples of q; of equal stretches the smallest lag stays.

Every text is handled whole, in one row; memory grows with the longest text of a batch only.

Defined results: null, empty and blank texts have no words, no runs and an empty collapsed text; repeated rows get
equal results; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.llm import tokens

LEAST_WORDS, LEAST_CYCLES = 24, 3
#: Words of the first windows, and how many earlier occurrences open a lag.
WINDOW, NEAREST = 8, 3
#: Bytes of text that a task holds at once, or one text.
SLICE_BYTES = 4_000_000
#: Words that are compared at first when a lag is followed.
STEP = 64
SHIFT = np.uint64(0x9E3779B97F4A7C15)


def numbered(words: list[bytes]) -> np.ndarray:
    """For each word the place of its first occurrence: equal numbers mean equal words."""
    first: dict[bytes, int] = {}
    return np.fromiter(map(first.setdefault, words, range(len(words))), np.int64, len(words))


def recurring(hashes: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(lag, place) of each window that equals one of its nearest earlier occurrences at a lag of low to high - 1; None
    if no two windows are equal."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    lags, places = [], []
    for k in range(1, min(NEAREST, len(order) - 1) + 1):
        same = np.flatnonzero(ordered[k:] == ordered[:-k])
        if not len(same):
            break
        later = order[same + k]
        lag = later - order[same]
        fits = (lag >= low) & (lag < high)
        lags.append(lag[fits])
        places.append(later[fits])
    if not lags:
        return None
    return np.concatenate(lags), np.concatenate(places)


def opened(codes: np.ndarray, least: int, cycles: int) -> Iterator[tuple[int, int]]:
    """(lag, place) where a lag may open: at the first of adjoining places of each lag."""
    n, size = len(codes), WINDOW
    if n < least:
        return
    hashes = tokens.mixed(codes.astype(np.uint64) + SHIFT)
    for width in (1, 2, 4):
        hashes = hashes[:-width] * (SHIFT + np.uint64(2 * width)) + hashes[width:]
    low = 1
    while len(hashes) > 1 and cycles * low <= n:
        high = 2 * size
        found = recurring(hashes, low, min(high, n // cycles + 1))
        if found is None:
            return  # no window recurs, so no longer one does
        lags, places = found
        if len(lags):
            order = np.lexsort((places, lags))
            lags, places = lags[order], places[order]
            adjoins = (lags[1:] == lags[:-1]) & (places[1:] == places[:-1] + 1)
            heads = np.concatenate(([True], ~adjoins))
            yield from zip(lags[heads].tolist(), places[heads].tolist(), strict=True)
        hashes = hashes[:-size] * (SHIFT + np.uint64(2 * size)) + hashes[size:]
        size, low = high, high


def matching(left: np.ndarray, right: np.ndarray) -> int:
    """How many leading words are equal."""
    done, step, n = 0, STEP, len(left)
    while done < n:
        same = left[done : done + step] == right[done : done + step]
        if not same.all():
            return done + int(same.argmin())
        done, step = done + len(same), 2 * step
    return done


def found_runs(codes: np.ndarray, least: int = LEAST_WORDS, cycles: int = LEAST_CYCLES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    n = len(codes)
    ended: dict[int, int] = {}
    period: dict[tuple[int, int], int] = {}
    for lag, place in opened(codes, least, cycles):
        if place < ended.get(lag, 0):
            continue  # the lag is still open here
        end = place + matching(codes[place:], codes[place - lag : n - lag])
        begin = place - matching(codes[lag:place][::-1], codes[: place - lag][::-1])
        ended[lag] = max(end, place + 1)
        length = end - begin + lag
        if length >= max(least, cycles * lag):
            stretch = (begin - lag, end)
            period[stretch] = min(lag, period.get(stretch, lag))
    return sorted((start, end - start, lag) for (start, end), lag in period.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by spaces."""
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, lag in runs:
        edges[start + lag] += 1
        edges[start + length] -= 1
    gone = np.cumsum(edges[:-1]) > 0
    return b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)


def periodic(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = LEAST_WORDS, cycles: int = LEAST_CYCLES
) -> DataFrame:
    """The ``keep`` columns with n_words, runs (array of start, length and period, by start and period) and collapsed, the
    text without what its runs repeat. At least three periods are needed for a run: ``cycles`` may not be less."""
    if cycles < 3 or least < 24:
        raise ValueError("windows of half the length of a run open its lag: at least 3 cycles and 24 words")
    narrow = docs.select(*keep, F.col(text).alias("__text"))
    width = len(keep)
    names = [*keep, "n_words", "runs", "collapsed"]
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tokens.sliced(whole, width, SLICE_BYTES):
                counts, lists, texts = [], [], []
                for value in batch.column(width):
                    words = (value.as_py() or "").encode().split()  # bytes split at the six separators only
                    runs = found_runs(numbered(words), least, cycles)
                    counts.append(len(words))
                    lists.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    texts.append(collapsed(words, runs) if runs else b" ".join(words))
                columns = [pa.array(counts, pa.int64()), pa.array(lists, runs_type), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *columns], names=names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:width]]
    fields += ["n_words bigint", "runs array<struct<start: bigint, length: bigint, period: bigint>>", "collapsed string"]
    return narrow.mapInArrow(tokens.releasing(scanned), ", ".join(fields))
