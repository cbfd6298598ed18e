"""Exploratory statistics of the feature table by class."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.operators.ordered import top_k
from flowscope.operators.sampling import downsample_class
from flowscope.operators.summary import collect_summary, summarize
from flowscope.schema import LABEL

BINS = 40


def class_distribution(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows per class and their rounded share of the whole in percent."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("n")).scalar()
    return counts.withColumn("percent", F.round(F.col("n") / total * 100, 0))


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair in long form ``f1, f2, r``; null where a column is constant.

    The matrix is computed on the executors; only its k*k cells reach the driver.
    """
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(df.select(*columns))
    matrix = Correlation.corr(vectors, "_v").first()[0].toArray()
    stats = collect_summary(df, columns)
    constant = np.array([stats[c]["low"] == stats[c]["high"] for c in columns])
    matrix[constant | constant[:, None]] = np.nan
    cells = pd.DataFrame(
        {"f1": np.repeat(columns, len(columns)), "f2": np.tile(columns, len(columns)), "r": matrix.ravel()}
    )
    out = df.sparkSession.createDataFrame(cells, "f1 string, f2 string, r double")
    return out.withColumn("r", F.nullif("r", F.lit(float("nan"))))


def gram_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """``X'X`` with a leading column of ones, in one pass: a partial matrix per task, added on the executors."""
    k = len(columns) + 1

    def partials(batches):
        total = np.zeros((k, k))
        for batch in batches:
            x = np.column_stack([np.ones(len(batch)), batch.to_numpy(dtype=float)])
            total += x.T @ x
        yield pd.DataFrame({"i": range(k), "row": list(total)})

    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    parts = doubles.mapInPandas(partials, "i int, row array<double>")
    vectors = parts.select("i", array_to_vector("row").alias("v"))
    rows = vectors.groupBy("i").agg(Summarizer.sum(F.col("v")).alias("s")).select("i", vector_to_array("s").alias("s"))
    return np.array([r["s"] for r in sorted(rows.collect(), key=lambda r: r["i"])])


def vif_from_gram(gram: np.ndarray) -> list[float | None]:
    """Variance inflation of each column regressed on the others without an added intercept.

    The total sum of squares is centred when the others contain or span a constant, as least-squares
    libraries do; a column that the others explain entirely has infinite inflation, a zero column none.
    """
    n, k = gram[0, 0], gram.shape[0] - 1
    scale = np.sqrt(np.diag(gram))
    scale[scale == 0] = 1.0
    unit = gram / np.outer(scale, scale)
    factors: list[float | None] = []
    for i in range(1, k + 1):
        others = [j for j in range(1, k + 1) if j != i]
        own = unit[i, i]
        if own == 0:
            factors.append(None)
            continue
        inverse = np.linalg.pinv(unit[np.ix_(others, others)], rcond=1e-12, hermitian=True)
        residual = own - unit[i, others] @ inverse @ unit[others, i]
        constant_gap = unit[0, 0] - unit[0, others] @ inverse @ unit[others, 0]
        total = own - unit[0, i] ** 2 if constant_gap < 1e-10 else own
        if total <= 1e-12:
            factors.append(None)
        else:
            factors.append(float("inf") if residual < 1e-12 else float(total / residual))
    assert n > 0
    return factors


def vif(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = list(zip(columns, vif_from_gram(gram_matrix(df, columns))))
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")


def class_column_sums(df: DataFrame, features: Sequence[str], label: str = LABEL) -> DataFrame:
    """Per feature the sum over benign and over malware rows, in order of the benign sum."""
    return class_measures(summarize(df, features, [label]), "total", label).orderBy("benign", "feature")


def class_means(df: DataFrame, features: Sequence[str], label: str = LABEL) -> DataFrame:
    return class_measures(summarize(df, features, [label]), "mean", label)


def class_measures(stats: DataFrame, measure: str, label: str = LABEL) -> DataFrame:
    """Summary rows ``(label, feature, ...)`` to ``feature, benign, malware`` for one measure."""
    side = lambda value: F.max(F.when(F.col(label) == value, F.col(measure)))
    return stats.groupBy("feature").agg(side(0).alias("benign"), side(1).alias("malware"))


def sparse_class_sums(cells: DataFrame, label: str = LABEL) -> DataFrame:
    """The same from the long form ``(label, feature, value)``: work grows with the non-zero cells only."""
    side = lambda value: F.sum(F.when(F.col(label) == value, F.col("value")).otherwise(0.0))
    return cells.groupBy("feature").agg(side(0).alias("benign"), side(1).alias("malware"))


def active_columns(df: DataFrame, features: Sequence[str], label: str = LABEL) -> DataFrame:
    """How many features are non-zero anywhere in each class."""
    return summarize(df, features, [label]).groupBy(label).agg(F.count_if(F.col("nonzero") > 0).alias("active"))


def histogram(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), bins: int = BINS, ranges_from: DataFrame | None = None) -> DataFrame:
    """Equal-width counts ``(*by, feature, bin, n)``; the last bin is closed, a constant column gets width 1.

    ``ranges_from`` sets the table the bin edges come from.
    """
    stats = collect_summary(df if ranges_from is None else ranges_from, features)
    cells = []
    for c in features:
        low, high = stats[c]["low"], stats[c]["high"]
        if low == high:
            low, high = low - 0.5, high + 0.5
        width = (high - low) / bins
        index = F.least(F.floor((F.col(c) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
        cells.append(F.struct(F.lit(c).alias("feature"), index.alias("bin")))
    long = df.select(*by, F.explode(F.array(*cells)).alias("cell")).select(*by, "cell.*")
    return long.groupBy(*by, "feature", "bin").agg(F.count("*").alias("n"))


def class_histogram(
    df: DataFrame,
    features: Sequence[str],
    row_id: str,
    label: str = LABEL,
    benign_percent: float = 100.0,
    bins: int = BINS,
    seed: int = 42,
) -> DataFrame:
    """Histograms by class. Edges come from all rows, counts from malware and a benign downsample."""
    drawn = downsample_class(df, row_id, label, benign_percent, seed=seed) if benign_percent < 100 else df
    return histogram(drawn, features, [label], bins, ranges_from=df)


def distinct_ratio(df: DataFrame, column: str, label: str = LABEL) -> DataFrame:
    """Distinct values per row in each class; values are combined per class before they are counted."""
    per_value = df.groupBy(label, column).agg(F.count("*").alias("n"))
    return per_value.groupBy(label).agg((F.count(column) / F.sum("n")).alias("ratio"))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return top_k(df.groupBy(column).agg(F.count("*").alias("n")), "n", k, [column])


def select_by_importance(importances: DataFrame, value: str = "importance", limit: float = 0.03) -> DataFrame:
    """Keep what rounds (two places) to at least the limit."""
    return importances.where(F.round(value, 2) >= limit)
