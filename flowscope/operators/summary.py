"""Per-column statistics of a wide table, and the projections fitted on them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NARROW = 16  # up to here plain aggregates are faster than the vector summarizer
MEASURES = ["n", "mean", "variance", "total", "low", "high", "nonzero"]


def _narrow(df: DataFrame, features: Sequence[str], by: list[str]) -> DataFrame:
    def measures(c: str):
        x = F.col(c).cast("double")
        return F.struct(
            F.lit(c).alias("feature"),
            F.count(x).alias("n"),
            F.avg(x).alias("mean"),
            F.var_samp(x).alias("variance"),
            F.sum(x).alias("total"),
            F.min(x).alias("low"),
            F.max(x).alias("high"),
            F.count_if(x != 0).alias("nonzero"),
        ).alias(c)

    stats = df.groupBy(*by).agg(*[measures(c) for c in features])
    return stats.select(*by, F.explode(F.array(*[F.col(f"`{c}`") for c in features])).alias("s")).select(*by, "s.*")


def _wide(df: DataFrame, features: Sequence[str], by: list[str]) -> DataFrame:
    vectors = VectorAssembler(inputCols=list(features), outputCol="_v").transform(df.select(*by, *features))
    return summarize_vector(vectors, "_v", features, by)


def _exact_constants(stats: DataFrame) -> DataFrame:
    """Merging partial variances leaves rounding noise on a constant column; its variance is 0."""
    variance = F.when((F.col("low") == F.col("high")) & (F.col("n") > 1), 0.0).otherwise(F.col("variance"))
    return stats.withColumn("variance", variance)


def summarize_vector(df: DataFrame, vector: str, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``summarize`` of a vector column whose entries are the named features."""
    metrics = Summarizer.metrics("count", "mean", "variance", "sum", "min", "max", "numNonZeros")
    stats = df.groupBy(*by).agg(metrics.summary(F.col(vector)).alias("s"))
    arrays = [vector_to_array(f"s.{m}") for m in ("mean", "variance", "sum", "min", "max", "numNonZeros")]
    names = F.array(*[F.lit(c) for c in features])
    zipped = F.arrays_zip(names.alias("feature"), *[a.alias(m) for a, m in zip(arrays, MEASURES[1:])])
    rows = stats.select(*by, F.col("s.count").alias("n"), F.explode(zipped).alias("z"))
    return rows.select(
        *by,
        "z.feature",
        "n",
        "z.mean",
        F.when(F.col("n") > 1, F.col("z.variance")).alias("variance"),
        "z.total",
        "z.low",
        "z.high",
        F.col("z.nonzero").cast("bigint").alias("nonzero"),
    )


def summarize(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per (group, feature): count, mean, sample variance, sum, min, max, non-zero count; one pass."""
    return _exact_constants((_narrow if len(features) <= NARROW else _wide)(df, features, list(by)))


def collect_summary(df: DataFrame, features: Sequence[str]) -> dict[str, dict]:
    """The same over the whole table on the driver: one small row per column."""
    return {row["feature"]: row.asDict() for row in summarize(df, features).collect()}


@dataclass(frozen=True)
class Scaling:
    """``(x - shift) / scale`` per column. ``scale`` None marks a column that becomes ``constant``."""

    shift: dict[str, float]
    scale: dict[str, float | None]
    constant: float | None = 0.0

    def expression(self, c: str):
        if self.scale[c] is None:
            return F.lit(self.constant).cast("double").alias(c)
        return ((F.col(c) - F.lit(self.shift[c])) / F.lit(self.scale[c])).alias(c)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select(*[self.expression(c) if c in self.scale else F.col(c) for c in df.columns])


def fit_minmax(df: DataFrame, features: Sequence[str]) -> Scaling:
    """To 0..1; a constant column becomes 0."""
    stats = collect_summary(df, features)
    span = {c: (stats[c]["high"] - stats[c]["low"]) or None for c in features}
    return Scaling({c: stats[c]["low"] for c in features}, span)


def fit_zscore(df: DataFrame, features: Sequence[str]) -> Scaling:
    """Sample standard deviation; a constant column has no score."""
    stats = collect_summary(df, features)
    spread = {c: math.sqrt(stats[c]["variance"] or 0.0) or None for c in features}
    return Scaling({c: stats[c]["mean"] for c in features}, spread, None)


def fit_standard(df: DataFrame, features: Sequence[str]) -> Scaling:
    """Population standard deviation; a constant column is only centred."""
    stats = collect_summary(df, features)
    deviation = {c: math.sqrt((stats[c]["variance"] or 0.0) * (1 - 1 / stats[c]["n"])) for c in features}
    return Scaling({c: stats[c]["mean"] for c in features}, {c: deviation[c] or 1.0 for c in features})


def minmax_scale(df: DataFrame, features: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    return fit_minmax(df if fit_on is None else fit_on, features).apply(df)


def zscore(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return fit_zscore(df, features).apply(df)


def standard_scale(df: DataFrame, features: Sequence[str], fit_on: DataFrame) -> DataFrame:
    """Fit on one set (the benign training rows, say) and apply to another."""
    return fit_standard(fit_on, features).apply(df)


def nonzero_columns(df: DataFrame, features: Sequence[str]) -> list[str]:
    stats = collect_summary(df, features)
    return [c for c in features if stats[c]["nonzero"] > 0]


def prune_zero_columns(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Drop the features that are 0 in every row."""
    live = set(nonzero_columns(df, features))
    return df.select(*[c for c in df.columns if c in live or c not in features])
