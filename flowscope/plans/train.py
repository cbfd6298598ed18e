"""Scale, sample, fit and score."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.detectors import kernel
from flowscope.operators.columns import ONE_CLASS, recode_label
from flowscope.operators.evaluate import classification_scores, f_beta
from flowscope.operators.sampling import class_ratio_sample, kfold, one_class_split, train_test_split
from flowscope.operators.summary import minmax_scale
from flowscope.schema import LABEL
from flowscope.session import materialized

SVM_FOLDS, ONE_CLASS_FOLDS = 10, 2  # fixed values
CONCURRENT_FOLDS = 5


def load_dataset(
    table: DataFrame,
    features: Sequence[str],
    row_id: str,
    size: int,
    malware_percent: float = 20.0,
    test_percent: float = 20.0,
    one_class: bool = False,
    label: str = LABEL,
    seed: int = 42,
) -> DataFrame:
    """Scale the whole table to 0..1, label included, and draw the class-ratio sample.

    The sample is written once, since every fit and split that follows reads it several times.
    """
    scaled = minmax_scale(table.select(row_id, label, *features), [*features, label])
    scaled = scaled.withColumn(label, F.col(label).cast("int"))
    if one_class:
        recoded = recode_label(scaled, ONE_CLASS, label)
        sample = class_ratio_sample(recoded, row_id, label, size, malware_percent, test_percent, 1, -1, seed)
    else:
        sample = class_ratio_sample(scaled, row_id, label, size, malware_percent, seed=seed)
    return materialized(sample, "sample")


def train_svm(
    data: DataFrame, features: Sequence[str], row_id: str, label: str = LABEL, test_fraction: float = 0.2, seed: int = 42, **settings
) -> tuple[PipelineModel, DataFrame]:
    """Classifier fitted on the train rows, and the scored test rows."""
    split = train_test_split(data, row_id, test_fraction, seed)
    model = kernel.fit_svm(split.where("split = 'train'"), features, label, seed=seed, **settings)
    return model, model.transform(split.where("split = 'test'"))


def train_one_class(
    data: DataFrame, features: Sequence[str], row_id: str, malware_percent: float, label: str = LABEL, **settings
) -> tuple[PipelineModel, DataFrame]:
    """Model of the benign train rows; held-out benign and all malware rows are scored. Labels are 1 / -1."""
    split = one_class_split(data, row_id, label)
    nu = kernel.one_class_nu(malware_percent)
    model = kernel.fit_one_class(split.where("split = 'train'"), features, nu, **settings)
    return model, model.transform(split.where("split = 'test'"))


def cross_validate(
    data: DataFrame,
    row_id: str,
    fit: Callable[[DataFrame], PipelineModel],
    folds: int = SVM_FOLDS,
    label: str = LABEL,
    positive: int = 1,
    stratified: bool = True,
    seed: int = 42,
) -> DataFrame:
    """Mean accuracy, precision and recall over the folds, and F2 of the two means.

    ``fit`` is called once per fold on the other folds. Give the test part as ``data`` for the reference
    protocol, which refits on the held-out part only; give the training part for the usual one.
    """
    folded = materialized(kfold(data, row_id, folds, seed, label if stratified else None), "folds")

    def scored(fold: int) -> list:
        model = fit(folded.where(F.col("fold") != fold).drop("fold"))
        judged = model.transform(folded.where(F.col("fold") == fold).drop("fold"))
        return classification_scores(judged, label, "prediction", positive).collect()

    # folds are independent, and a step of a fit is a small job
    with ThreadPoolExecutor(CONCURRENT_FOLDS) as pool:
        scores = [row for rows in pool.map(scored, range(folds)) for row in rows]
    table = data.sparkSession.createDataFrame(scores)
    means = table.agg(*[F.avg(c).alias(c) for c in ("accuracy", "precision", "recall")])
    return means.withColumn("f_beta", f_beta(2.0, F.col("precision"), F.col("recall")))
