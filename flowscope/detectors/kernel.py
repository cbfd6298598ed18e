"""Kernel detectors on landmark features.

Spark's support-vector machine is linear. With landmarks L and their kernel matrix ``K(L, L) = U S U'`` the features
``z(x) = K(x, L) U S^-1/2`` (Nystroem) have ``z(x).z(y)`` equal to ``exp(-gamma |x - y|^2)`` on the landmarks and close to it
elsewhere, so a linear machine on z is the radial-basis one, exactly if every distinct training row is a landmark.
Landmarks are training rows, drawn by their ridge leverage, so rows that the others can't stand for come first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.schema import LABEL
from flowscope.session import materialized

# --- fixed values: detector settings ---------------------------------------------------------------
SVM_C = 100.0
GAMMA = 0.1
SVM_SEED = 42
SVM_TOLERANCE = 1e-3
ONE_CLASS_TEST_SHARE = 0.20
GRID_X = (-8.0, 6.0)
GRID_Y = (-3.0, 3.0)
GRID_STEPS = 30
# --- end of fixed values ---------------------------------------------------------------------------
COMPONENTS = 512
ROWS_PER_TASK = 5_000
SLICE_ROWS = 1_000
CALIBRATION_FOLDS = 5
#: Eigenvalues of the landmarks' kernel below this share of the largest are noise.
RANK_TOLERANCE = 1e-10


def gaussian(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2.0 * x @ y.T
    return np.exp(-gamma * np.maximum(squares, 0.0))


class Basis:
    """The map of rows to landmark features."""

    def __init__(self, landmarks: np.ndarray, gamma: float) -> None:
        self.landmarks, self.gamma = landmarks, gamma
        values, vectors = np.linalg.eigh(gaussian(landmarks, landmarks, gamma))
        kept = values > RANK_TOLERANCE * values[-1]
        self.root = vectors[:, kept] / np.sqrt(values[kept])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), self.root.shape[1]))
        for at in range(0, len(x), SLICE_ROWS):  # a batch of Arrow rows needs room for its features, not for the steps between
            np.matmul(gaussian(x[at : at + SLICE_ROWS], self.landmarks, self.gamma), self.root, out=out[at : at + SLICE_ROWS])
        return out


def choose_landmarks(rows: DataFrame, count: int, gamma: float, seed: int) -> np.ndarray:
    """At most ``count`` distinct rows of ``x``, drawn without replacement in proportion to their ridge leverage.

    Half as many rows, drawn evenly, give first features; their Gram matrix over all rows gives each row's leverage.
    Draws follow from a hash of the row's values and the seed, so they do not depend on the partitioning, and equal rows
    are one. Only ``count`` rows and a matrix of ``count / 2`` columns reach the driver.
    """
    keyed = rows.select("x", F.xxhash64("x").alias("h"))
    uniform = (F.shiftrightunsigned(F.xxhash64("h", F.lit(seed)), 11) + 0.5) / float(1 << 53)

    def drawn(weight: Column, n: int) -> np.ndarray:
        turns = keyed.select("h", (-F.log(uniform) / weight).alias("turn")).groupBy("h").agg(F.min("turn").alias("turn"))
        first = turns.orderBy("turn", "h").limit(n)
        picked = keyed.join(F.broadcast(first), "h").groupBy("h").agg(F.first("x").alias("x"), F.min("turn").alias("turn"))
        return np.array([r.x for r in sorted(picked.collect(), key=lambda r: (r.turn, r.h))])

    pilot = drawn(F.lit(1.0), max(1, count // 2))
    if not len(pilot):
        raise ValueError("no rows to choose landmarks from")
    basis = Basis(pilot, gamma)
    size = basis.root.shape[1]

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((size, size)), 0
        for batch in batches:
            z = basis(np.stack(batch["x"].to_numpy()))
            total, n = total + z.T @ z, n + len(z)
        yield pd.DataFrame({"total": [total.ravel()], "n": [n]})

    parts = rows.select("x").mapInPandas(gram, "total array<double>, n long")
    added = parts.agg(Summarizer.sum(array_to_vector("total")).alias("total"), F.sum("n").alias("n")).first()
    total = added["total"].toArray().reshape(size, size)
    ridge = max(added["n"] - np.trace(total), 1e-6 * added["n"]) / count
    inverse = np.linalg.inv(total + ridge * np.eye(size))

    @F.pandas_udf("double")
    def leverage(x: pd.Series) -> pd.Series:
        z = basis(np.stack(x.to_numpy()))
        unexplained = np.maximum(1.0 - (z * z).sum(axis=1), 0.0) / ridge
        return pd.Series(np.maximum(np.einsum("ij,ij->i", z @ inverse, z) + unexplained, 1e-12))

    return drawn(leverage("x"), count)


class _Landmarks(Params):
    landmarks = Param(Params._dummy(), "landmarks", "landmark rows, one after the other", TypeConverters.toListFloat)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    dim = Param(Params._dummy(), "dim", "length of the input vector", TypeConverters.toInt)

    def basis(self) -> Basis:
        rows = np.array(self.getOrDefault("landmarks")).reshape(-1, self.getOrDefault("dim"))
        return Basis(rows, self.getOrDefault("gamma"))


class LandmarkFeatures(Transformer, _Landmarks, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Vector to vector; only the landmarks are stored."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, dim=None, landmarks=None, gamma=GAMMA):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        basis = self.basis()

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            return pd.Series(list(basis(np.stack(x.to_numpy()))))

        mapped = array_to_vector(project(vector_to_array(F.col(self.getInputCol()))))
        return dataset.withColumn(self.getOutputCol(), mapped)


def fit_svm(
    df: DataFrame,
    features: Sequence[str],
    label: str = LABEL,
    c: float = SVM_C,
    gamma: float = GAMMA,
    components: int = COMPONENTS,
    seed: int = SVM_SEED,
    probability: bool = True,
    max_iter: int = 100,
) -> PipelineModel:
    """Radial-basis classifier with penalty ``c``: hinge loss with regularisation ``1 / (c n)``.

    The pipeline adds ``prediction``, ``rawPrediction`` and, by logistic calibration on margins that models of the
    other folds gave, ``probability``.
    """
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    source = assembler.transform(df).select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias(label), "features")
    # written, as the landmarks' draws and every step of the optimiser read them again: the optimiser's tasks then carry a
    # scan and not the map to the features
    source = materialized(source, "svm_rows")
    n = source.count()
    landmarks = choose_landmarks(source, components, gamma, seed)
    kernel = LandmarkFeatures(inputCol="features", outputCol="kernel", dim=len(features), landmarks=landmarks.ravel().tolist(), gamma=gamma)
    fold = F.pmod(F.xxhash64("x", F.lit(seed + 1)), F.lit(CALIBRATION_FOLDS)).alias("fold")
    train = materialized(kernel.transform(source).select("kernel", label, fold), "svm_features")
    # a sample of a large table comes in many small pieces, and every optimiser step visits all of them
    compact = train.coalesce(max(1, math.ceil(n / ROWS_PER_TASK)))

    def machine(rows: DataFrame, size: int):
        svc = LinearSVC(
            featuresCol="kernel",
            labelCol=label,
            regParam=1.0 / (c * max(size, 1)),
            standardization=False,
            maxIter=max_iter,
            tol=SVM_TOLERANCE,
        )
        return svc.fit(rows)

    sizes = dict(train.groupBy("fold").count().collect()) if probability else {}

    def held_out(k: int) -> DataFrame | None:
        if n == sizes[k]:
            return None
        others = machine(compact.where(F.col("fold") != k), n - sizes[k])
        return others.transform(compact.where(F.col("fold") == k)).select("rawPrediction", label)

    # the machines are independent, and a step of one is a small job
    with ThreadPoolExecutor(CALIBRATION_FOLDS + 1) as pool:
        whole = pool.submit(machine, compact, n)
        parts = [p for p in pool.map(held_out, sorted(sizes)) if p is not None]
        stages = [assembler, kernel, whole.result()]
    if probability:
        # equal rows share a fold; if there is no other, their own margins have to do
        parts = parts or [stages[-1].transform(compact).select("rawPrediction", label)]
        calibration = LogisticRegression(
            featuresCol="rawPrediction",
            labelCol=label,
            rawPredictionCol="calibration",
            probabilityCol="probability",
            predictionCol="calibrated",
        )
        stages.append(calibration.fit(reduce(DataFrame.union, parts)))
    return PipelineModel(stages)


def calibration_table(scored: DataFrame, label: str = LABEL, bins: int = 10) -> DataFrame:
    """``bin, n, probability, share, error``: of the rows in each bin of equal width their mean probability and share of
    label 1; ``error`` is the mean gap between the two over all rows."""
    p = vector_to_array("probability")[1]
    place = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int").alias("bin")
    table = scored.groupBy(place).agg(F.count("*").alias("n"), F.avg(p).alias("probability"), F.avg((F.col(label) == 1).cast("double")).alias("share"))
    gaps = table.agg((F.sum(F.col("n") * F.abs(F.col("probability") - F.col("share"))) / F.sum("n")).alias("error"))
    return table.withColumn("error", gaps.scalar())


def decision_value() -> Column:
    """Signed distance of a scored row."""
    return vector_to_array(F.col("rawPrediction"))[1]


class OneClassModel(Transformer, _Landmarks, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """``decision = w.z(x) - rho`` and ``prediction`` 1 inside, -1 outside; with the certificate of the fit."""

    weights = Param(Params._dummy(), "weights", "normal vector", TypeConverters.toListFloat)
    rho = Param(Params._dummy(), "rho", "offset", TypeConverters.toFloat)
    gap = Param(Params._dummy(), "gap", "duality gap, relative to the objective", TypeConverters.toFloat)
    outside = Param(Params._dummy(), "outside", "share of training rows outside", TypeConverters.toFloat)
    support = Param(Params._dummy(), "support", "share of training rows with a weight", TypeConverters.toFloat)
    rounds = Param(Params._dummy(), "rounds", "rounds of the fit", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self, *, inputCol=None, outputCol=None, dim=None, landmarks=None, gamma=None, weights=None, rho=None, gap=None, outside=None, support=None, rounds=None
    ):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        score = score_udf(self.basis(), np.array(self.getOrDefault("weights")))
        values = vector_to_array(F.col(self.getInputCol()))
        decided = dataset.withColumn(self.getOutputCol(), score(values) - self.getOrDefault("rho"))
        return decided.withColumn("prediction", F.when(F.col(self.getOutputCol()) >= 0, 1).otherwise(-1))


def score_udf(basis: Basis, weights: np.ndarray):
    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(basis(np.stack(x.to_numpy())) @ weights)

    return score


def one_class_nu(malware_percent: float) -> float:
    return malware_percent / 100.0 * ONE_CLASS_TEST_SHARE


def pair_steps(z: np.ndarray, alpha: np.ndarray, scores: np.ndarray, bound: float, tolerance: float) -> np.ndarray:
    """New weights of these rows: weight moves from the row with the highest score that has some to the row with the lowest that
    has room, until no two rows violate the optimum by more than ``tolerance``. The total stays."""
    alpha, scores = alpha.copy(), scores.copy()
    norms, slack = (z * z).sum(axis=1), 1e-12 * bound
    for _ in range(PAIR_STEPS * len(z)):
        low = np.where(alpha < bound - slack, scores, np.inf)
        high = np.where(alpha > slack, scores, -np.inf)
        i, j = int(low.argmin()), int(high.argmax())
        if not high[j] - low[i] > tolerance:
            break
        curve = max(norms[i] + norms[j] - 2.0 * z[i] @ z[j], 1e-12)
        step = min((scores[j] - scores[i]) / curve, bound - alpha[i], alpha[j])
        alpha[i], alpha[j] = alpha[i] + step, alpha[j] - step
        scores += step * (z @ (z[i] - z[j]))
    return np.clip(alpha, 0.0, bound)


#: Pair steps of a row and round, at most; where they end early, the next round goes on.
PAIR_STEPS = 20
QUANTILE_ACCURACY = 10_000


def fit_one_class(
    df: DataFrame,
    features: Sequence[str],
    nu: float,
    gamma: float = GAMMA,
    components: int = 256,
    seed: int = SVM_SEED,
    tolerance: float = 1e-4,
    rounds: int = 50,
    rows_per_task: int = ROWS_PER_TASK,
) -> PipelineModel:
    """One-class machine (Schoelkopf 2001) by its dual: weights of 0 to ``1 / (nu n)`` that add up to 1, with the shortest
    weighted mean ``w`` of the rows.

    In a round the rows are dealt anew into tasks; each task makes pair steps on its rows, as if the others stood still, and
    writes their new weights. The tasks' changes add up to a direction along which the best step is known in closed form, so
    no round makes ``w`` longer. Any ``w`` gives a bound on the optimum: the rounds end when the gap between ``w`` and that
    bound is under ``tolerance`` of the objective, or after ``rounds``; the gap is kept in the model. Only
    vectors of ``components`` numbers reach the driver. ``rho`` is at most the nu-quantile of the final scores, so no more than a
    share nu of the training rows lies outside, and no less than that share has a weight.
    """
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    source = materialized(assembler.transform(df).select(vector_to_array("features").alias("x")), "one_class_rows")
    n = source.count()
    basis = Basis(choose_landmarks(source, components, gamma, seed), gamma)
    size, bound, tasks = basis.root.shape[1], 1.0 / (nu * n) if nu * n > 1 else 1.0, max(1, math.ceil(n / rows_per_task))
    fields = "place bigint, x array<double>, alpha double, change double"
    # an even start is feasible; the place tells equal rows apart
    state = source.withColumns({"place": F.monotonically_increasing_id(), "alpha": F.lit(1.0 / n), "change": F.lit(0.0)})
    state = materialized(state.select("place", "x", "alpha", "change"), "weights")

    def mean() -> np.ndarray:
        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(size)
            for batch in batches:
                total += basis(np.stack(batch["x"].to_numpy())).sum(axis=0)
            yield pd.DataFrame({"total": [total / n]})

        parts = source.mapInPandas(partial, "total array<double>")
        return parts.agg(Summarizer.sum(array_to_vector("total")).alias("total")).first()["total"].toArray()

    def moved(weights: np.ndarray, step: float, margin: float):
        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if len(b)]  # rows_per_task rows, about
            if not held:
                return
            rows = pa.Table.from_batches(held)
            z = basis(np.stack(rows["x"].to_numpy()))
            before = rows["alpha"].to_numpy() + step * rows["change"].to_numpy()
            after = pair_steps(z, before, z @ weights, bound, margin)
            change = after - before
            table = pa.table({"place": rows["place"], "x": rows["x"], "alpha": before, "change": change})
            yield from table.to_batches()
            # the task's direction, as a row of its own
            whole = {"place": pa.array([None], pa.int64()), "x": pa.array([change @ z], pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_pydict({**whole, "alpha": pa.array([None], pa.float64()), "change": pa.array([None], pa.float64())})

        return move

    def judged(weights: np.ndarray) -> tuple[float, float]:
        """rho and the gap."""
        scores = source.select(score_udf(basis, weights)("x").alias("s"))
        rank = max(nu - 1.0 / QUANTILE_ACCURACY, 0.0)
        rho = scores.agg(F.percentile_approx("s", rank, QUANTILE_ACCURACY)).first()[0]
        hinge = scores.agg(F.sum(F.greatest(F.lit(rho) - F.col("s"), F.lit(0.0)))).first()[0]
        square = float(weights @ weights)
        return rho, (square - rho + hinge * bound) / max(square / 2, 1e-300)

    weights, step, done = mean(), 0.0, 0
    rho, gap = judged(weights)
    while gap > tolerance and done < rounds:
        margin = 0.1 * tolerance * float(weights @ weights)
        spread = F.pmod(F.xxhash64("place", F.lit(done)), F.lit(tasks)).cast("int")
        rows = state.where("place is not null").withColumn("task", spread).repartitionById(tasks, "task").drop("task")
        state = materialized(rows.mapInArrow(moved(weights, step, margin), fields), "weights")
        way = state.where("place is null").agg(Summarizer.sum(array_to_vector("x")).alias("way")).first()["way"].toArray()
        length = float(way @ way)
        step = min(max(-float(weights @ way) / length, 0.0), 1.0) if length > 0 else 0.0
        weights, done = weights + step * way, done + 1
        rho, gap = judged(weights)
        if step == 0.0 and tasks == 1:
            break  # no pair of rows is left to move
    final = F.col("alpha") + step * F.col("change")
    support = state.where("place is not null").agg(F.avg((final > 1e-9 * bound).cast("double"))).first()[0]
    outside = source.agg(F.avg((score_udf(basis, weights)("x") < F.lit(rho)).cast("double"))).first()[0]
    model = OneClassModel(
        inputCol="features",
        outputCol="decision",
        dim=len(features),
        landmarks=basis.landmarks.ravel().tolist(),
        gamma=gamma,
        weights=[float(v) for v in weights],
        rho=float(rho),
        gap=float(gap),
        outside=float(outside),
        support=float(support),
        rounds=done,
    )
    return PipelineModel([assembler, model])


def one_class_certificate(spark, model: PipelineModel, nu: float) -> DataFrame:
    """``nu, outside, support, gap, rounds``: the shares of the training rows, and how far the fit is from the optimum at most."""
    fit = model.stages[-1]
    row = (nu, *[fit.getOrDefault(p) for p in ("outside", "support", "gap", "rounds")])
    return spark.createDataFrame([row], "nu double, outside double, support double, gap double, rounds int")


def score_grid(
    spark, x_range: tuple[float, float] = GRID_X, y_range: tuple[float, float] = GRID_Y, steps: int = GRID_STEPS
) -> DataFrame:
    """Even grid ``(gx, gy)`` over two ranges, ends included."""
    at = lambda place, low, high: F.lit(low) + place * F.lit((high - low) / (steps - 1))
    cells = spark.range(steps * steps)
    column, row = F.col("id") % steps, F.floor(F.col("id") / steps)
    return cells.select(at(column, *x_range).alias("gx"), at(row, *y_range).alias("gy"))
