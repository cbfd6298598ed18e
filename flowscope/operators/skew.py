"""Joins and ranks that stay parallel when one key holds a large share of the rows.

Hot keys are found with a bounded sketch in one column-pruned scan without a shuffle. They only decide how
rows are spread, never which rows come out, so a missed or falsely reported hot key costs time, not results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64
HOT_KEYS = 200
SKETCH_ITEMS = 20_000
BROADCAST_ROWS = 500_000


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def hot_keys(df: DataFrame, keys: Sequence[str]) -> Column:
    """Scalar ``array<bigint>``: hashes of the keys that hold more than 1/HOT_KEYS of the rows."""
    sketch = df.select(key_hash(keys).alias("h")).agg(
        F.expr(f"approx_top_k(h, {HOT_KEYS}, {SKETCH_ITEMS})").alias("top"), F.count("*").alias("n")
    )
    frequent = F.filter("top", lambda item: item["count"] * HOT_KEYS > F.col("n"))
    return sketch.select(F.transform(frequent, lambda item: item["item"]).alias("hot")).scalar()


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    hot_source: DataFrame | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join where ``left`` may have hot keys and ``right`` has few rows per key.

    Left rows of a hot key are split over ``salts`` partitions by a hash of the ``spread`` columns (stable
    under task retries, unlike a random salt); only the right rows of hot keys are copied to match.
    ``hot_source`` names a cheaper table with the same key skew to sketch instead of ``left``.
    """
    hot = hot_keys(left if hot_source is None else hot_source, keys)
    is_hot = F.array_contains(hot, key_hash(keys))
    slot = F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(salts)).cast("int")
    left = left.withColumn("_salt", F.when(is_hot, slot).otherwise(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = right.withColumn("_salt", F.explode(copies))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def distinct_estimate(df: DataFrame, keys: Sequence[str]) -> int:
    """Upper estimate of the number of distinct keys: a sketch in one scan, plus five standard errors."""
    return int(df.agg(F.approx_count_distinct(key_hash(keys), 0.02)).first()[0] * 1.1) + 1


def attach(
    left: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    rows: int | None = None,
    hot_source: DataFrame | None = None,
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left join with a lookup table of one narrow row per key.

    ``rows`` bounds the size of the lookup; without it the lookup is counted. Up to ``limit`` rows it is
    broadcast, beyond that the join is salted.
    """
    if (lookup.count() if rows is None else rows) <= limit:
        return left.join(F.broadcast(lookup), list(keys), "left")
    return salted_join(left, lookup, keys, spread, "left", hot_source)


def rank_in_group(
    df: DataFrame, keys: Sequence[str], order: str, name: str, hot_source: DataFrame | None = None, pieces: int = SALTS
) -> DataFrame:
    """1-based row number within ``keys`` by the unique numeric column ``order``.

    A hot group is cut into ``pieces`` ranges of ``order``; each range is numbered on its own and shifted by
    the sizes of the ranges before it, so no task sorts a whole hot group. Other groups are one range.
    """
    source = df if hot_source is None else hot_source
    hot = F.array_contains(hot_keys(source, keys), key_hash(keys))
    steps = ", ".join(str(i / pieces) for i in range(1, pieces))
    cuts = source.agg(F.expr(f"approx_percentile({order}, array({steps}), 10000)").alias("cuts")).scalar()
    piece = F.when(F.col("_hot"), F.size(F.filter("_cuts", lambda c: c < F.col(order)))).otherwise(0)
    pieced = df.withColumns({"_hot": hot, "_cuts": cuts}).withColumn("_piece", piece).drop("_cuts")

    # at most HOT_KEYS * pieces rows
    sizes = pieced.where("_hot").groupBy(*keys, "_piece").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*keys, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    number = F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(order))
    return (
        pieced.withColumn("_number", number)
        .join(F.broadcast(shifts), [*keys, "_piece"], "left")
        .withColumn(name, (F.col("_number") + F.coalesce("_shift", F.lit(0))).cast("bigint"))
        .drop("_hot", "_piece", "_number", "_shift")
    )
