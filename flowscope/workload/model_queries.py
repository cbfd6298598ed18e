"""Detectors and reductions over the embedding vectors, labelled by parity."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowscope.detectors import autoencoder, kernel, reduction
from flowscope.operators import evaluate
from flowscope.operators.profile import corr_matrix
from flowscope.operators.summary import fit_minmax
from flowscope.plans import study, train
from flowscope.session import scratch_path
from flowscope.sources.models import load_model, save_model
from flowscope.workload import fixtures as fx
from flowscope.workload.fixtures import Registry

MODELS = Registry()
ID, LABEL = "vec_id", "malware_label"
EPOCHS = 200


def dataset(spark, sf, one_class=False, share=20.0):
    """The vectors, scaled and sampled to a class ratio; persisting is left to the fit."""
    rows, names = fx.embeddings(spark, sf)
    size = rows.count()
    return train.load_dataset(rows, names, ID, size, share, 20.0, one_class, LABEL), names


@MODELS.add("pca")
def pca(spark, sf):
    rows, names = fx.embeddings(spark, sf)
    return reduction.pca(rows, names, 10, LABEL, [ID])


@MODELS.add("component_correlations")
def component_correlations(spark, sf):
    """Correlation of the leading components and the label."""
    rows, names = fx.embeddings(spark, sf)
    components = reduction.pca(rows, names, 5, LABEL, [ID])
    return corr_matrix(components, ["pc1", "pc2", "pc3", "pc4", "pc5", LABEL])


@MODELS.add("explained_variance_curve")
def explained_variance_curve(spark, sf):
    rows, names = fx.embeddings(spark, sf)
    return reduction.explained_variance_curve(rows, names)


VECTOR_NAMES = [LABEL, *[f"e{i}" for i in range(64)]]
VECTORS = "SELECT vec_id, label % 2 AS malware_label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(64)) + " FROM embeddings"


@MODELS.add(
    "study_correlations",
    # a correlation of standardised columns is that of the columns
    f"""WITH v AS ({VECTORS}), u AS (UNPIVOT v ON {", ".join(VECTOR_NAMES[1:])} INTO NAME f VALUE x),
    w AS (SELECT vec_id, f, x FROM u UNION ALL SELECT vec_id, '{LABEL}', {LABEL} FROM v)
  SELECT a.f AS f1, b.f AS f2, round(corr(a.x, b.x), 6) AS r FROM w AS a JOIN w AS b ON a.vec_id = b.vec_id GROUP BY a.f, b.f""",
)
def study_correlations(spark, sf):
    rows, names = fx.embeddings(spark, sf)
    return study.correlations(rows, names, LABEL).withColumn("r", F.round("r", 6))


@MODELS.add("forest_importances")
def forest_importances(spark, sf):
    """The 50 most important components."""
    rows, names = fx.embeddings(spark, sf)
    return study.leading_features(rows, names, ID, LABEL)


@MODELS.add("forest_select")
def forest_select(spark, sf):
    rows, names = fx.embeddings(spark, sf)
    return reduction.forest_select(rows, names, LABEL, row_id=ID, limit=0.02, keep=[ID])


@MODELS.add("random_projection")
def random_projection(spark, sf):
    rows, names = fx.embeddings(spark, sf)
    return reduction.random_projection(rows, names, 8, LABEL, [ID])


@MODELS.add("svm_rbf")
def svm_rbf(spark, sf):
    """Predictions, margins and calibrated probabilities of the test rows."""
    data, names = dataset(spark, sf, share=40.0)
    _, scored = train.train_svm(data, names, ID)
    probability = F.round(vector_to_array("probability")[1], 6).alias("probability")
    return scored.select(ID, LABEL, "prediction", F.round(kernel.decision_value(), 6).alias("decision"), probability)


@MODELS.add("svm_calibration")
def svm_calibration(spark, sf):
    """How well the probabilities of the test rows fit their labels."""
    data, names = dataset(spark, sf, share=40.0)
    _, scored = train.train_svm(data, names, ID)
    table = kernel.calibration_table(scored, LABEL)
    return table.select("bin", "n", *[F.round(c, 6).alias(c) for c in ("probability", "share", "error")])


@MODELS.add("svm_margin_grid")
def svm_margin_grid(spark, sf):
    """Decision value and region label over the plane of the first two components."""
    rows, names = fx.embeddings(spark, sf)
    plane = reduction.pca(rows, names, 2, LABEL, [ID]).withColumnsRenamed({"pc1": "gx", "pc2": "gy"})
    model, _ = train.train_svm(plane, ["gx", "gy"], ID)
    scored = model.transform(kernel.score_grid(spark))
    return scored.select("gx", "gy", F.round(kernel.decision_value(), 6).alias("decision"), "prediction")


@MODELS.add("svm_cross_validation")
def svm_cross_validation(spark, sf):
    """Ten stratified folds over the held-out part, as the original protocol scores it."""
    data, names = dataset(spark, sf, share=40.0)
    held = train.train_test_split(data, ID).where("split = 'test'").drop("split")
    fit = lambda part: kernel.fit_svm(part, names, LABEL, probability=False)
    return train.cross_validate(held, ID, fit, train.SVM_FOLDS, LABEL)


@MODELS.add("score_saved")
def score_saved(spark, sf):
    """Fit, save, load, and score a new sample with the loaded model."""
    data, names = dataset(spark, sf, share=40.0)
    model, _ = train.train_svm(data, names, ID, probability=False)
    path = scratch_path(spark, "svm")
    save_model(model, path)
    scored = load_model(spark, path).transform(data)
    return evaluate.confusion_matrix(scored, LABEL, "prediction")


@MODELS.add("one_class_svm")
def one_class_svm(spark, sf):
    """1 inside the benign region, -1 outside."""
    data, names = dataset(spark, sf, one_class=True)
    _, scored = train.train_one_class(data, names, ID, 20.0)
    return scored.select(ID, LABEL, "prediction", F.round("decision", 6).alias("decision"))


@MODELS.add("one_class_certificate")
def one_class_certificate(spark, sf):
    """Shares of training rows outside and with a weight, on both sides of nu, and the duality gap."""
    data, names = dataset(spark, sf, one_class=True)
    model, _ = train.train_one_class(data, names, ID, 20.0)
    return kernel.one_class_certificate(spark, model, kernel.one_class_nu(20.0))


@MODELS.add("one_class_saved")
def one_class_saved(spark, sf):
    """Fit, save, load, and score all rows with the loaded model."""
    data, names = dataset(spark, sf, one_class=True)
    model, _ = train.train_one_class(data, names, ID, 20.0)
    path = scratch_path(spark, "one_class")
    save_model(model, path)
    scored = load_model(spark, path).transform(data)
    return scored.select(ID, LABEL, "prediction", F.round("decision", 6).alias("decision"))


@MODELS.add("one_class_scores")
def one_class_scores(spark, sf):
    """Scores for the benign class, the positive one by default here."""
    data, names = dataset(spark, sf, one_class=True)
    _, scored = train.train_one_class(data, names, ID, 20.0)
    return evaluate.classification_scores(scored, LABEL, "prediction", positive=1)


@MODELS.add("autoencoder_score")
def autoencoder_score(spark, sf):
    """Row losses, threshold and anomaly flag of an autoencoder trained on the benign rows."""
    data, names = dataset(spark, sf)
    scored, _ = autoencoder.autoencoder_scores(data, names, ID, LABEL, epochs=EPOCHS)
    return scored


@MODELS.add("autoencoder_saved")
def autoencoder_saved(spark, sf):
    """Fit, save, load, and score all rows with the loaded network; the threshold then compares all rows, times 3."""
    data, names = dataset(spark, sf)
    benign = data.where(F.col(LABEL) == 0)
    model = autoencoder.fit_autoencoder(benign, names, ID, autoencoder.bottleneck_layout(len(names)), epochs=EPOCHS)
    path = scratch_path(spark, "autoencoder")
    model.save(spark, path)
    scored, _ = autoencoder.autoencoder_scores(data, names, ID, LABEL, autoencoder.Autoencoder.load(spark, path))
    return scored


@MODELS.add("autoencoder_history")
def autoencoder_history(spark, sf):
    """Training and validation loss per epoch."""
    rows, names = fx.embeddings(spark, sf)
    benign = fit_minmax(rows, names).apply(rows).where(F.col(LABEL) == 0)
    model = autoencoder.fit_autoencoder(benign, names, ID, autoencoder.bottleneck_layout(len(names)), epochs=EPOCHS)
    return model.loss_history(spark)


@MODELS.add("deep_autoencoder")
def deep_autoencoder(spark, sf):
    """Squared reconstruction error of the validation rows by true class."""
    rows, names = fx.embeddings(spark, sf)
    return autoencoder.deep_autoencoder(rows, names, ID, 4, LABEL, epochs=EPOCHS).errors
