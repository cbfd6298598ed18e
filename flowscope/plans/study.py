"""Feature study of a table: prune, profile, select."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from flowscope.detectors.reduction import forest_importances
from flowscope.operators.ordered import top_k
from flowscope.operators.profile import corr_matrix
from flowscope.operators.sampling import train_test_split
from flowscope.operators.summary import nonzero_columns, zscore
from flowscope.schema import LABEL

TOP_FEATURES = 50  # fixed value


def correlations(df: DataFrame, features: Sequence[str], label: str = LABEL) -> DataFrame:
    """Correlation of the standardised live features and the label."""
    live = nonzero_columns(df, features)
    return corr_matrix(zscore(df.select(label, *live), live), [label, *live])


def leading_features(df: DataFrame, features: Sequence[str], row_id: str, label: str = LABEL, k: int = TOP_FEATURES) -> DataFrame:
    """The most important features of a forest fitted on 70% of the rows."""
    live = nonzero_columns(df, features)
    train = train_test_split(df, row_id, 0.3, 123).where("split = 'train'")
    return top_k(forest_importances(train, live, label), "importance", k, ["feature"])
