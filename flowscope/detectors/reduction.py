"""Table to table feature reduction: components, forest selection, random projection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowscope.detectors.network import Layout
from flowscope.operators.profile import select_by_importance
from flowscope.operators.sampling import train_test_split
from flowscope.operators.summary import Scaling, collect_summary, fit_minmax, minmax_scale
from flowscope.schema import LABEL

FOREST_SEED = 123  # fixed value
FOREST_TEST_SHARE = 0.3  # fixed value


def _centred(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Scaled to 0..1 and centred in one projection: ``(x - mean) / (max - min)``."""
    stats = collect_summary(df, features)
    span = {c: (stats[c]["high"] - stats[c]["low"]) or None for c in features}
    scaling = Scaling({c: stats[c]["mean"] for c in features}, span)
    return VectorAssembler(inputCols=list(features), outputCol="_x").transform(scaling.apply(df))


def _signs(model: PCAModel) -> list[float]:
    """Turn each component so that its largest loading is positive."""
    loadings = model.pc.toArray()
    return [1.0 if column[np.argmax(np.abs(column))] >= 0 else -1.0 for column in loadings.T]


def pca(
    df: DataFrame, features: Sequence[str], components: int = 10, label: str = LABEL, keep: Sequence[str] = (), include_label: bool = False
) -> DataFrame:
    """Principal components ``pc1..pck`` of the scaled features, with the label carried along."""
    columns = [*features, label] if include_label else list(features)
    source = df.withColumn("_label", F.col(label))
    vectors = _centred(source, columns)
    model = PCA(k=components, inputCol="_x", outputCol="_pc").fit(vectors)
    values = vector_to_array("_pc")
    parts = [(values[i] * F.lit(sign)).alias(f"pc{i + 1}") for i, sign in enumerate(_signs(model))]
    return model.transform(vectors).select(*keep, *parts, F.col("_label").alias(label))


def explained_variance_curve(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``component, ratio, cumulative`` for all components."""
    model = PCA(k=len(features), inputCol="_x", outputCol="_pc").fit(_centred(df.select(*features), features))
    rows = [(i + 1, float(r)) for i, r in enumerate(model.explainedVariance.toArray())]
    ratios = df.sparkSession.createDataFrame(rows, "component int, ratio double")
    upto = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ratios.withColumn("cumulative", F.sum("ratio").over(upto))


def forest_importances(
    df: DataFrame,
    features: Sequence[str],
    label: str = LABEL,
    trees: int = 100,
    max_depth: int = 10,
    seed: int = FOREST_SEED,
) -> DataFrame:
    """``feature, importance`` of a random forest, one row per feature."""
    scaled = fit_minmax(df, features).apply(df.select(*features, F.col(label).cast("double").alias(label)))
    vectors = VectorAssembler(inputCols=list(features), outputCol="_x").transform(scaled)
    forest = RandomForestClassifier(
        featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=max_depth, seed=seed
    ).fit(vectors.select("_x", label))
    rows = list(zip(features, (float(v) for v in forest.featureImportances.toArray())))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def forest_select(
    df: DataFrame,
    features: Sequence[str],
    label: str = LABEL,
    trees: int = 100,
    max_depth: int = 10,
    row_id: str | None = None,
    limit: float = 0.03,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The important features, scaled to 0..1, next to the label.

    With ``row_id`` the forest is fitted on a 70% split, without it on all rows.
    """
    fit_on = df
    if row_id is not None:
        fit_on = train_test_split(df, row_id, FOREST_TEST_SHARE, FOREST_SEED).where("split = 'train'")
    importances = forest_importances(fit_on, features, label, trees, max_depth)
    chosen = {r["feature"] for r in select_by_importance(importances, limit=limit).collect()}
    names = [c for c in features if c in chosen]
    return minmax_scale(df.select(*keep, label, *names), names)


def random_projection(
    df: DataFrame, features: Sequence[str], count: int, label: str = LABEL, keep: Sequence[str] = (), seed: int = 2
) -> DataFrame:
    """Scaled features through an untrained rectified encoder of halving widths to ``count`` outputs."""
    dim = len(features)
    layout = Layout((dim, dim // 2, dim // 4, dim // 8, count), ("relu",) * 4)
    shared = df.sparkSession.sparkContext.broadcast(layout.initial(seed))

    @F.pandas_udf("array<double>")
    def encode(x: pd.Series) -> pd.Series:
        return pd.Series(list(layout.predict(shared.value, np.stack(x.to_numpy()))))

    scaled = minmax_scale(df.select(*keep, label, *features), features)
    encoded = scaled.withColumn("_code", encode(F.array(*[F.col(c).cast("double") for c in features])))
    return encoded.select(*keep, *[F.col("_code")[i].alias(f"f{i + 1}") for i in range(count)], label)
