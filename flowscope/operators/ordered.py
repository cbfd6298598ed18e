"""Ordered computations over a whole table without sorting it in one task.

Rows are cut into value ranges at approximate quantiles, so many that a range has ``ROWS_PER_RANGE`` rows; each range is
worked on by itself, and the totals of the ranges before it are added. Those come from a tree of two levels: ranges are
summed in groups, groups are summed up in order, and so are the ranges of each group, so no task sees more than
``TOGETHER`` ranges or all groups. A value that repeats among the quantiles holds many rows; it gets a range of its
own, cut further by the tie-break column.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"
ROWS_PER_RANGE = 1_000_000
#: Cuts that the driver computes and sends along at most (8 bytes each); beyond that ranges grow with the table.
MAX_RANGES = 100_000
TOGETHER = 300


def _cuts(df: DataFrame, column: str, buckets: int) -> list[float]:
    steps = [i / buckets for i in range(1, buckets)]
    cuts = df.approxQuantile(column, steps, 1.0 / (4 * buckets)) if steps else []
    return [cut + 0.0 for cut in cuts]


def _bucketize(df: DataFrame, column: str, splits: list[float], name: str) -> DataFrame:
    if not splits:
        return df.withColumn(name, F.lit(0))
    edges = [-math.inf, *splits, math.inf]
    # -0.0 sorts as 0.0 but would be searched as less
    order = F.when(F.col(column) == 0, 0.0).otherwise(F.col(column).cast("double"))
    marked = Bucketizer(splits=edges, inputCol="_order", outputCol=name).transform(df.withColumn("_order", order))
    return marked.withColumn(name, F.col(name).cast("int")).drop("_order")


def range_buckets(df: DataFrame, order: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Add ``_bucket``, which never decreases along ``order`` (one or two numeric, non-null columns)."""
    if buckets is None:
        least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(1, min(max(least, math.ceil(df.count() / ROWS_PER_RANGE)), MAX_RANGES))
    cuts = _cuts(df, order[0], buckets)
    hot = [value for value, times in Counter(cuts).items() if times > 1] if len(order) > 1 else []
    splits = sorted(set(cuts) | {math.nextafter(value, math.inf) for value in hot})
    bucketed = _bucketize(df, order[0], splits, BUCKET)
    if not hot:
        return bucketed
    inner = sorted(set(_cuts(df.where(F.col(order[0]).isin(hot)), order[1], buckets)))
    bucketed = _bucketize(bucketed, order[1], inner, "_inner")
    piece = F.when(F.col(order[0]).isin(hot), F.col("_inner")).otherwise(0)
    return bucketed.withColumn(BUCKET, F.col(BUCKET) * (len(inner) + 1) + piece).drop("_inner")


def earlier(totals: DataFrame, sums: dict[str, str], nexts: dict[str, str] | None = None, descending: bool = False) -> DataFrame:
    """``_bucket`` with, for each named column, its sum over all ranges before; ``nexts`` names columns of which the next
    range's value is wanted. ``totals`` has a row for each range."""
    nexts = nexts or {}
    turn = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    grouped = totals.withColumn("_group", F.floor(F.col(BUCKET) / TOGETHER))
    over_groups, over_ranges = Window.orderBy(turn("_group")), Window.partitionBy("_group").orderBy(turn(BUCKET))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    first = F.min_by if not descending else F.max_by
    groups = grouped.groupBy("_group").agg(
        *[F.sum(c).alias(f"_sum_{name}") for name, c in sums.items()], *[first(c, BUCKET).alias(f"_first_{name}") for name, c in nexts.items()]
    )
    groups = groups.select(
        "_group",
        *[F.coalesce(F.sum(f"_sum_{name}").over(before(over_groups)), F.lit(0)).alias(f"_sum_{name}") for name in sums],
        *[F.lead(f"_first_{name}").over(over_groups).alias(f"_first_{name}") for name in nexts],
    )
    inside = grouped.select(
        BUCKET,
        "_group",
        *[F.coalesce(F.sum(c).over(before(over_ranges)), F.lit(0)).alias(name) for name, c in sums.items()],
        *[F.lead(c).over(over_ranges).alias(name) for name, c in nexts.items()],
    )
    return inside.join(F.broadcast(groups), "_group").select(
        BUCKET,
        *[(F.col(name) + F.col(f"_sum_{name}")).alias(name) for name in sums],
        *[F.coalesce(name, f"_first_{name}").alias(name) for name in nexts],
    )


def cumulative_sum(
    df: DataFrame, order: Sequence[str], value: str, name: str = "cumulative", buckets: int | None = None
) -> DataFrame:
    """Running total of ``value`` along ``order``, whose columns together identify a row."""
    bucketed = range_buckets(df, order, buckets)
    inside = Window.partitionBy(BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shifts = earlier(bucketed.groupBy(BUCKET).agg(F.sum(value).alias("_total")), {"_shift": "_total"})
    return (
        bucketed.withColumn("_running", F.sum(value).over(inside))
        .join(F.broadcast(shifts), BUCKET)
        .withColumn(name, F.col("_running") + F.col("_shift"))
        .drop(BUCKET, "_running", "_shift")
    )


def row_ids(df: DataFrame, order: Sequence[str], name: str = "row_id", buckets: int | None = None) -> DataFrame:
    """Dense 0-based ids along ``order``, whose columns together identify a row."""
    bucketed = range_buckets(df, order, buckets)
    shifts = earlier(bucketed.groupBy(BUCKET).agg(F.count("*").alias("_n")), {"_shift": "_n"})
    number = F.row_number().over(Window.partitionBy(BUCKET).orderBy(*order))
    return (
        bucketed.withColumn("_number", number)
        .join(F.broadcast(shifts), BUCKET)
        .withColumn(name, (F.col("_number") - 1 + F.col("_shift")).cast("bigint"))
        .drop(BUCKET, "_number", "_shift")
    )


def top_k(df: DataFrame, value: str, k: int, tie_break: Sequence[str] = (), largest: bool = True) -> DataFrame:
    """The k rows with the largest (or smallest) value; each task keeps k rows, there is no full sort."""
    first = F.col(value).desc() if largest else F.col(value).asc()
    return df.orderBy(first, *tie_break).limit(k)
