"""Scores of detectors against known labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowscope.operators.ordered import BUCKET, earlier, range_buckets
from flowscope.schema import LABEL


# --- reconstruction error --------------------------------------------------------------------------
def row_mae(actual: Sequence[str], predicted: Sequence[str]) -> Column:
    """Mean absolute difference of two lists of columns."""
    return sum((F.abs(F.col(a) - F.col(p)) for a, p in zip(actual, predicted)), F.lit(0.0)) / len(actual)


def row_mse(actual: Sequence[str], predicted: Sequence[str]) -> Column:
    return sum((F.pow(F.col(a) - F.col(p), 2) for a, p in zip(actual, predicted)), F.lit(0.0)) / len(actual)


def array_mae(actual: Column, predicted: Column) -> Column:
    """The same over two array columns."""
    parts = F.zip_with(actual, predicted, lambda a, p: F.abs(a.cast("double") - p.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x) / F.size(actual)


def array_mse(actual: Column, predicted: Column) -> Column:
    parts = F.zip_with(actual, predicted, lambda a, p: F.pow(a.cast("double") - p.cast("double"), 2))
    return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x) / F.size(actual)


TRAINED, LOADED = 4.0, 3.0  # fixed values: threshold multiplier after training, after loading


def mae_threshold(
    train: DataFrame, predicted: DataFrame, train_features: Sequence[str], predicted_features: Sequence[str], k: float = TRAINED
) -> DataFrame:
    """One row ``threshold = |mean |predicted| - mean |train|| * k`` over all cells."""
    size = lambda df, cols: df.agg(F.avg(sum((F.abs(F.col(c)) for c in cols), F.lit(0.0)) / len(cols)))
    gap = F.abs(size(predicted, predicted_features).scalar() - size(train, train_features).scalar())
    return train.sparkSession.range(1).select((gap * k).alias("threshold"))


def error_by_class(df: DataFrame, loss: str, threshold: float | Column, label: str = LABEL) -> DataFrame:
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return df.groupBy(label).agg(
        F.count("*").alias("n"),
        F.avg(loss).alias("mean_loss"),
        F.min(loss).alias("min_loss"),
        F.max(loss).alias("max_loss"),
        F.count_if(F.col(loss) > limit).alias("anomalies"),
    )


# --- hard predictions ------------------------------------------------------------------------------
def confusion_matrix(df: DataFrame, label: str, prediction: str, values: tuple[int, int] = (0, 1)) -> DataFrame:
    """All four cells ``(label, prediction, n)``, empty ones included; one aggregate without a grouping key."""
    cells = [(t, p) for t in values for p in values]
    counts = df.agg(
        *[F.count_if((F.col(label) == t) & (F.col(prediction) == p)).alias(f"c{i}") for i, (t, p) in enumerate(cells)]
    )
    rows = [
        F.struct(F.lit(t).alias("label"), F.lit(p).alias("prediction"), F.col(f"c{i}").alias("n"))
        for i, (t, p) in enumerate(cells)
    ]
    return counts.select(F.explode(F.array(*rows)).alias("cell")).select("cell.*")


def ratio(top: Column, bottom: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(bottom == 0, 0.0).otherwise(F.try_divide(top.cast("double"), bottom))


def f_beta(beta: float, precision: Column, recall: Column) -> Column:
    b = beta * beta
    return ratio((b + 1) * precision * recall, b * precision + recall)


def classification_scores(
    df: DataFrame, label: str, prediction: str, positive: int = 1, beta: float = 2.0, by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, precision, recall and F-beta for the class ``positive`` in one aggregate."""
    truth, said = F.col(label) == positive, F.col(prediction) == positive
    counts = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(label) == F.col(prediction)).alias("right"),
        F.count_if(truth & said).alias("tp"),
        F.count_if(said).alias("said"),
        F.count_if(truth).alias("truth"),
    )
    scored = counts.select(
        *by,
        ratio(F.col("right"), F.col("n")).alias("accuracy"),
        ratio(F.col("tp"), F.col("said")).alias("precision"),
        ratio(F.col("tp"), F.col("truth")).alias("recall"),
    )
    return scored.withColumn("f_beta", f_beta(beta, F.col("precision"), F.col("recall")))


# --- ranking scores --------------------------------------------------------------------------------
def score_counts(df: DataFrame, score: str, label: str, positive: int = 1) -> DataFrame:
    """Positive and negative rows per distinct score."""
    is_positive = F.col(label) == positive
    return df.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(is_positive).alias("pos"), F.count_if(~is_positive).alias("neg")
    )


def _sweep(df: DataFrame, score: str, label: str, positive: int, buckets: int | None) -> DataFrame:
    """Every distinct score from high to low with the counts at and above it and the next score's own counts."""
    counts = score_counts(df, score, label, positive)
    bucketed = range_buckets(counts, ["threshold"], buckets)
    down = Window.partitionBy(BUCKET).orderBy(F.desc("threshold"))
    upto = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = bucketed.select(
        "*",
        F.sum("pos").over(upto).alias("tp_in"),
        F.sum("neg").over(upto).alias("fp_in"),
        F.lead("pos").over(down).alias("next_pos_in"),
        F.lead("neg").over(down).alias("next_neg_in"),
    )
    ranges = bucketed.groupBy(BUCKET).agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("q"),
        F.max_by("pos", "threshold").alias("top_pos"),
        F.max_by("neg", "threshold").alias("top_neg"),
    )
    shifts = earlier(
        ranges, {"tp_before": "p", "fp_before": "q"}, {"next_top_pos": "top_pos", "next_top_neg": "top_neg"}, descending=True
    )
    whole = ranges.agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"))
    shifts = shifts.withColumns({c: whole.select(c).scalar() for c in whole.columns})
    return own.join(F.broadcast(shifts), BUCKET).select(
        "threshold",
        "pos",
        "neg",
        (F.col("tp_in") + F.col("tp_before")).alias("tp"),
        (F.col("fp_in") + F.col("fp_before")).alias("fp"),
        F.coalesce("next_pos_in", "next_top_pos").alias("next_pos"),
        F.coalesce("next_neg_in", "next_top_neg").alias("next_neg"),
        "positives",
        "negatives",
    )


def roc_curve(
    df: DataFrame,
    score: str,
    label: str,
    positive: int = 1,
    drop_intermediate: bool = True,
    origin: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """``threshold, fpr, tpr`` per distinct score.

    ``drop_intermediate`` leaves out points on a straight line between their neighbours. ``origin`` adds the
    synthetic point (0, 0), which has no threshold.
    """
    sweep = _sweep(df, score, label, positive, buckets)
    if drop_intermediate:
        first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        last = F.col("next_pos").isNull()
        bends = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        sweep = sweep.where(first | last | bends)
    points = sweep.select(
        "threshold",
        F.try_divide("fp", "negatives").alias("fpr"),
        F.try_divide("tp", "positives").alias("tpr"),
    )
    if origin:
        start = df.sparkSession.range(1).select(
            F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
        )
        points = start.unionByName(points)
    return points


def roc_auc(df: DataFrame, score: str, label: str, positive: int = 1, buckets: int | None = None) -> DataFrame:
    """Area under the curve: each negative counts the positives above it and half of those beside it."""
    sweep = _sweep(df, score, label, positive, buckets)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return sweep.agg(F.try_divide(area, F.max(F.col("positives").cast("double") * F.col("negatives"))).alias("auc"))


def mean_roc_threshold(
    df: DataFrame, score: str, label: str, positive: int = 1, drop_intermediate: bool = True
) -> DataFrame:
    """Mean threshold of the curve to four places, without the synthetic first point."""
    points = roc_curve(df, score, label, positive, drop_intermediate)
    return points.agg(F.round(F.avg("threshold"), 4).alias("threshold"))


def pr_curve(df: DataFrame, score: str, label: str, positive: int = 1, buckets: int | None = None) -> DataFrame:
    """``threshold, precision, recall`` from the highest score down to where recall is full."""
    sweep = _sweep(df, score, label, positive, buckets)
    reached = F.col("tp") - F.col("pos") < F.col("positives")
    return sweep.where(reached).select(
        "threshold",
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.try_divide("tp", "positives").alias("recall"),
    )
