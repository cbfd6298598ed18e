"""Projections, predicates and label handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.schema import LABEL


def with_label(df: DataFrame, value: int, name: str = LABEL) -> DataFrame:
    """The same label for every row of a capture."""
    return df.withColumn(name, F.lit(value))


def split_features(df: DataFrame, label: str = LABEL) -> tuple[DataFrame, DataFrame]:
    """Features without the label, and the label alone."""
    return df.drop(label), df.select(label)


def select_prefix(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Columns whose name starts with ``prefix`` (anchored), after the kept ones."""
    return df.select(*keep, *[c for c in df.columns if c.startswith(prefix) and c not in keep])


def column_window(df: DataFrame, window: int, width: int = 30, keep: Sequence[str] = ()) -> DataFrame:
    """The ``window``-th run of ``width`` columns, not counting the kept ones."""
    rest = [c for c in df.columns if c not in keep]
    return df.select(*keep, *rest[window * width : (window + 1) * width])


def filter_class(df: DataFrame, value: int, label: str = LABEL) -> DataFrame:
    return df.where(F.col(label) == value)


def recode_label(df: DataFrame, mapping: dict[int, int], label: str = LABEL) -> DataFrame:
    """Map label values at once, so 0/1 to 1/-1 and back do not run into each other; others stay."""
    recoded = F.col(label)
    for old, new in mapping.items():
        recoded = F.when(F.col(label) == old, new).otherwise(recoded)
    return df.withColumn(label, recoded.cast("int"))


ONE_CLASS = {0: 1, 1: -1}  # fixed values: benign 0 -> 1, malware 1 -> -1
BINARY = {1: 0, -1: 1}


def sni_guard(name: Column, value: Column) -> Column:
    """The value where there is a server name, else 0."""
    return F.when(F.coalesce(name, F.lit("")) != "", value).otherwise(0)


def anomaly_flag(df: DataFrame, loss: str, threshold: float | Column, name: str = "anomaly") -> DataFrame:
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return df.withColumn(name, F.col(loss) > limit)


def keep_columns(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *names)


def zip_columns(left: DataFrame, right: DataFrame, row_id: str) -> DataFrame:
    """Put the columns of two tables over the same rows side by side, aligned by id."""
    return left.join(right, row_id)
