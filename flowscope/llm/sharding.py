"""Shards of near-equal size by histogram sort, with DataFrame operations only.

Rows have a 60-bit key: 32 bits of the text's hash, then 28 bits of the id's hash. So rows with equal texts lie
next to each other, and a text that holds a large share of all rows still spreads over many keys. Splitters come
from rounds of exact byte counts: each round cuts every open key interval into equal steps, sums the bytes in each
step over all partitions (a partial aggregate of at most ``shards * steps`` rows) and keeps the step that holds the
splitter. Then one range exchange puts the rows in order. A splitter that falls into the rows of one key, which repeat an
id and text, is refined in the same way over their places in the written table, so even a single row that repeats
without end is split evenly.

Defined results: a null text has no bytes and sorts with the empty text; a null id sorts with the empty id; of rows with
equal id and text any may come first; an empty table gives no rows; further columns are ignored. ``write_shards``, which
keeps no such places, leaves rows with equal id and text in one shard.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.llm.common import unused
from flowscope.session import materialized

KEY_BITS = 60
STEPS = 256


def sort_key(text: str, ident: str) -> Column:
    digits = [
        F.substring(F.md5(F.coalesce(F.col(name).cast("string"), F.lit(""))), 1, n) for name, n in ((text, 8), (ident, 7))
    ]
    return F.conv(F.concat(*digits), 16, 10).cast("bigint")


@dataclass
class Interval:
    """Keys from ``low`` up to ``high`` (exclusive) that hold a splitter; ``below`` is the weight under ``low``."""

    low: int
    high: int
    below: int


@dataclass
class Splitter:
    """The least boundary with the wanted weight below it; ``key`` is the one key that reaches it, if that is known, and
    ``below`` the weight under that key."""

    boundary: int
    key: int | None = None
    below: int = 0


def located(keyed: DataFrame, key: str, weight: str, wanted: dict[int, int], scale: int, high: int, slack: float = 0.0, steps: int = STEPS) -> dict[int, Splitter]:
    """For each i the least boundary with ``scale`` times the weight below it at ``wanted[i]`` or more, or one whose weight
    differs from that by at most ``slack``. ``keyed`` is read once per round, so it should be a written table."""
    found: dict[int, Splitter] = {}
    open_: dict[int, Interval] = {i: Interval(0, high, 0) for i in wanted}
    while open_:
        ranges = sorted({(x.low, x.high) for x in open_.values()})
        place = F.lit(None).cast("struct<low: bigint, step: bigint>")
        for low, top in ranges:
            width = max(1, -(-(top - low) // steps))
            inside = (F.col(key) >= low) & (F.col(key) < top)
            at = F.floor((F.col(key) - F.lit(low)) / F.lit(width)) if width < 2**40 else F.expr(f"({key} - {low}) div {width}")
            place = F.when(inside, F.struct(F.lit(low).cast("bigint").alias("low"), at.cast("bigint").alias("step"))).otherwise(place)
        sums = (
            keyed.select(place.alias("place"), key, weight)
            .where("place is not null")
            .groupBy("place")
            .agg(F.sum(weight).alias("weight"), F.min(key).alias("first"), F.max(key).alias("last"))
            .collect()
        )
        by_range: dict[int, list] = {}
        for row in sorted(sums, key=lambda r: (r.place.low, r.place.step)):
            by_range.setdefault(row.place.low, []).append(row)
        for i, interval in list(open_.items()):
            below = interval.below
            for row in by_range.get(interval.low, []):
                above = below + row.weight
                if above * scale >= wanted[i]:  # the boundary lies in this step
                    if row.first == row.last:
                        found[i] = Splitter(row.last + 1, row.last, below)
                    elif above - below <= slack:
                        found[i] = Splitter(row.last + 1)
                    else:
                        open_[i] = Interval(row.first, row.last + 1, below)
                    break
                below = above
            if i in found or not by_range.get(interval.low):
                found.setdefault(i, Splitter(interval.high))
                del open_[i]
    return found


def splitters(keyed: DataFrame, key: str, weight: str, shards: int, tolerance: float = 0.0, steps: int = STEPS) -> list[Splitter]:
    """Splitter i is the least key with at least i/shards of the weight below it, or one whose weight below differs
    from that by at most ``tolerance`` shards."""
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    found = located(keyed, key, weight, {i: i * total for i in range(1, shards)}, shards, 1 << KEY_BITS, tolerance * total / shards, steps)
    return [found[i] for i in range(1, shards)]


def refined(keyed: DataFrame, key: str, place: str, weight: str, shards: int, found: Sequence[Splitter]) -> list[tuple[int, int | None]]:
    """(boundary, place): where rows of one key reach a splitter, the key, and the least place whose rows lie beyond it."""
    keys = sorted({s.key for s in found if s.key is not None})
    repeated = {r[key] for r in keyed.where(F.col(key).isin(keys)).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").collect()} if keys else set()
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    places: dict[int, int] = {}
    for k in repeated:
        wanted = {i: i * total - shards * s.below for i, s in enumerate(found, 1) if s.key == k}
        places |= {i: s.boundary for i, s in located(keyed.where(F.col(key) == k), place, weight, wanted, shards, 1 << 62).items()}
    return [(s.key, places[i]) if i in places else (s.boundary, None) for i, s in enumerate(found, 1)]


def shard_of(key: Column, bounds: Sequence[tuple[int, int | None]], place: Column | None = None) -> Column:
    shard = F.lit(0)
    for bound, least in bounds:
        beyond = key >= F.lit(bound) if least is None else (key > F.lit(bound)) | ((key == F.lit(bound)) & (place >= F.lit(least)))
        shard = shard + beyond.cast("int")
    return shard.cast("int")


def shard_rows(docs: DataFrame, shards: int, text: str = "text", ident: str = "doc_id", tolerance: float = 0.0) -> DataFrame:
    """``docs`` as (id, size, text_crc32, shard, slot): ``size`` counts UTF-8 bytes plus one for a row's end, and slots
    number the rows of a shard from 0 in key order.

    The sorted table is written once; a row's slot is its place in its partition plus the rows of the partitions
    before it, so no task sorts a whole shard."""
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + F.lit(1)
    narrow = materialized(
        docs.select(
            F.col(ident).alias("id"),
            size.cast("bigint").alias("size"),
            F.crc32(F.col(text).cast("binary")).cast("bigint").alias("text_crc32"),
            sort_key(text, ident).alias("key"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "keys",
    )
    bounds = refined(narrow, "key", "row", "size", shards, splitters(narrow, "key", "size", shards, tolerance))
    placed = narrow.withColumn("shard", shard_of(F.col("key"), bounds, F.col("row")))
    ordered = placed.repartitionByRange("shard", "key", "row").sortWithinPartitions("shard", "key", "row")
    place = F.monotonically_increasing_id()
    ordered = materialized(ordered.withColumn("place", place).drop("key", "row"), "ordered")

    part = F.shiftright("place", 33).alias("part")
    counts = ordered.groupBy(part, "shard").agg(F.count("*").alias("n"), F.min("place").alias("first")).collect()
    shift, taken = {}, {}
    for row in sorted(counts, key=lambda r: (r.part, r.shard)):  # one row for each partition and shard that meet
        shift[row.part, row.shard] = taken.get(row.shard, 0) - row.first
        taken[row.shard] = taken.get(row.shard, 0) + row.n
    shifts = docs.sparkSession.createDataFrame(
        [(p, s, n) for (p, s), n in shift.items()], "part bigint, shard int, shift bigint"
    )
    return (
        ordered.withColumn("part", part)
        .join(F.broadcast(shifts), ["part", "shard"])
        .select("id", "size", "text_crc32", "shard", (F.col("place") + F.col("shift")).alias("slot"))
    )


def write_shards(docs: DataFrame, path: str, shards: int, text: str = "text", ident: str = "doc_id", tolerance: float = 0.0) -> None:
    """Whole rows of ``docs`` in folders ``shard=N``, in key order within and across the files of a shard. A column
    named shard is replaced."""
    size = (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + F.lit(1)).cast("bigint")
    narrow = materialized(docs.select(sort_key(text, ident).alias("key"), size.alias("size")), "keys")
    bounds = [(s.boundary, None) for s in splitters(narrow, "key", "size", shards, tolerance)]
    key = unused(docs, "_key")
    keyed = docs.withColumn(key, sort_key(text, ident)).withColumn("shard", shard_of(F.col(key), bounds))
    ordered = keyed.repartitionByRange("shard", key).sortWithinPartitions("shard", key)
    ordered.drop(key).write.partitionBy("shard").parquet(path)
