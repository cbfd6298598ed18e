import hashlib
import pathlib
import threading
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowscope.detectors import autoencoder, kernel, network, reduction, team
from flowscope.operators.evaluate import classification_scores, roc_auc
from flowscope.operators.profile import gram_matrix
from flowscope.plans import train
from flowscope.session import scratch_path
from flowscope.sources.models import load_model, save_model
from flowscope.workload import model_queries

NAMES = [f"x{i}" for i in range(8)]


@pytest.fixture(scope="module")
def clusters(spark):
    """Benign rows near 0.3, malware rows near 0.7."""
    rng = np.random.default_rng(3)
    label = (rng.random(400) < 0.3).astype(int)
    x = rng.normal(0.3, 0.06, (400, 8)) + 0.4 * label[:, None]
    rows = [(int(i), int(label[i]), *map(float, x[i])) for i in range(400)]
    df = spark.createDataFrame(rows, ["id", "malware_label", *NAMES])
    return df.select("id", F.col("malware_label").cast("int").alias("malware_label"), *NAMES).repartition(3).cache()


def test_landmark_features_give_the_kernel():
    rng = np.random.default_rng(0)
    x = rng.random((40, 8))
    z = kernel.Basis(x, 0.1)(x)
    assert np.abs(z @ z.T - kernel.gaussian(x, x, 0.1)).max() < 1e-7


def test_landmarks(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate((np.repeat(rng.random((1, 5)), 900, axis=0), rng.normal(0, 0.01, (95, 5)), 5 + rng.random((5, 5))))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    once, again = (kernel.choose_landmarks(part, 16, 0.5, 7) for part in (df, df.repartition(5)))
    assert np.array_equal(once, again) and len(np.unique(once, axis=0)) == 16
    assert (once > 4).all(axis=1).sum() >= 3  # of 5 in 101 distinct rows: few others stand for them
    assert len(kernel.choose_landmarks(df.where("x[0] > 4"), 16, 0.5, 7)) == 5


def exact_svm(x, y, c, gamma, steps=200_000):
    """Margins of the dual with offset, by pair steps on the whole kernel matrix."""
    k, alpha = kernel.gaussian(x, x, gamma), np.zeros(len(x))
    gradient = -np.ones(len(x))
    for _ in range(steps):
        up = ((y > 0) & (alpha < c - 1e-9)) | ((y < 0) & (alpha > 1e-9))
        down = ((y < 0) & (alpha < c - 1e-9)) | ((y > 0) & (alpha > 1e-9))
        violation = -y * gradient
        i, j = np.where(up, violation, -np.inf).argmax(), np.where(down, violation, np.inf).argmin()
        if violation[i] - violation[j] < 1e-5:
            break
        step = (violation[i] - violation[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = min(step, c - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else c - alpha[j])
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        gradient += y * step * (k[i] - k[j])
    return k @ (alpha * y) + (violation[i] + violation[j]) / 2


def test_svm_margins_equal_the_exact_ones(spark):
    rng = np.random.default_rng(5)
    label = (rng.random(300) < 0.4).astype(int)
    x = rng.normal(0.45, 0.15, (300, 8)) + 0.1 * label[:, None]
    rows = [(i, int(label[i]), *map(float, x[i])) for i in range(300)]
    df = spark.createDataFrame(rows, ["id", "malware_label", *NAMES])
    model = kernel.fit_svm(df, NAMES)
    got = model.transform(df).select("id", kernel.decision_value().alias("d")).toPandas().sort_values("id")["d"].to_numpy()
    want = exact_svm(x, 2.0 * label - 1, kernel.SVM_C, kernel.GAMMA)
    assert np.corrcoef(got, want)[0, 1] > 0.99
    table = kernel.calibration_table(model.transform(df)).collect()
    assert sum(r.n for r in table) == 300 and 0 <= table[0].error < 0.2
    assert table[0].error == pytest.approx(sum(r.n * abs(r.probability - r.share) for r in table) / 300)


def test_svm_separates_and_survives_saving(spark, clusters):
    model, scored = train.train_svm(clusters, NAMES, "id", components=128, max_iter=30)
    scores = classification_scores(scored, "malware_label", "prediction").first()
    assert scores.accuracy > 0.95 and 0 < scored.count() <= 80
    probability = scored.select(kernel.decision_value().alias("d"), kernel.vector_to_array("probability")[1].alias("p")).toPandas()
    assert ((probability.p.between(0, 1)).all()) and probability.corr(method="spearman").iloc[0, 1] > 0.99
    path = scratch_path(spark, "svm")
    save_model(model, path)
    again = load_model(spark, path).transform(scored.drop("features", "kernel", "rawPrediction", "prediction", "calibration", "probability", "calibrated"))
    pairs = scored.select("id", kernel.decision_value().alias("a")).join(again.select("id", kernel.decision_value().alias("b")), "id")
    assert pairs.where(F.abs(F.col("a") - F.col("b")) > 1e-9).count() == 0
    with pytest.raises(FileNotFoundError):
        load_model(spark, scratch_path(spark, "nothing"))


def exact_one_class(x, nu, gamma, steps=200_000):
    """Scores and square of the shortest mean, on the whole kernel matrix."""
    k, n = kernel.gaussian(x, x, gamma), len(x)
    alpha, bound = np.full(n, 1 / n), 1 / (nu * n)
    scores = k @ alpha
    for _ in range(steps):
        i = np.where(alpha < bound - 1e-12, scores, np.inf).argmin()
        j = np.where(alpha > 1e-12, scores, -np.inf).argmax()
        if scores[j] - scores[i] < 1e-9:
            break
        step = min((scores[j] - scores[i]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12), bound - alpha[i], alpha[j])
        alpha[i], alpha[j], scores = alpha[i] + step, alpha[j] - step, scores + step * (k[i] - k[j])
    return scores, alpha @ scores


@pytest.mark.parametrize("rows_per_task", [5000, 60])
def test_one_class_reaches_the_optimum(spark, clusters, rows_per_task):
    benign = clusters.where("malware_label = 0").orderBy("id")
    x, nu = benign.select(*NAMES).toPandas().to_numpy(), 0.1
    scores, square = exact_one_class(x, nu, kernel.GAMMA)
    model = kernel.fit_one_class(benign, NAMES, nu, components=len(x), tolerance=1e-3, rows_per_task=rows_per_task)
    fit = kernel.one_class_certificate(spark, model, nu).first()
    assert fit.outside <= nu <= fit.support and fit.gap <= 1e-3
    weights = np.array(model.stages[-1].getOrDefault("weights"))
    assert square <= weights @ weights * (1 + 1e-6) and weights @ weights <= square * (1 + fit.gap)
    got = model.transform(benign).select("decision").toPandas()["decision"].to_numpy()
    assert np.corrcoef(got, scores)[0, 1] > 0.99


def test_one_class_with_copies(spark, clusters):
    rows = clusters.where("malware_label = 0").limit(40)
    many = rows.unionByName(rows.limit(1).crossJoin(spark.range(300).select()))
    fit = kernel.one_class_certificate(spark, kernel.fit_one_class(many, NAMES, 0.05, rows_per_task=100), 0.05).first()
    assert fit.outside <= 0.05 <= fit.support


def test_one_class(spark, clusters):
    coded = clusters.withColumn("malware_label", F.when(F.col("malware_label") == 0, 1).otherwise(-1))
    model, scored = train.train_one_class(coded, NAMES, "id", 20.0, components=128)
    assert roc_auc(scored, "decision", "malware_label").first()[0] > 0.95
    path = scratch_path(spark, "one-class")
    save_model(model, path)
    again = load_model(spark, path).transform(scored.select("id", *NAMES)).select("id", F.col("decision").alias("b"))
    assert scored.join(again, "id").where(F.abs(F.col("decision") - F.col("b")) > 1e-9).count() == 0


def test_gradient_matches_differences():
    layout = network.Layout((5, 4, 3, 5), ("elu", "relu", "linear"), 1e-2)
    rng = np.random.default_rng(1)
    flat, x = layout.initial(0) + 0.05 * rng.normal(size=layout.length()), rng.random((6, 5))

    def objective(w):
        outputs = layout.forward(w, x)
        return np.mean((outputs[-1] - x) ** 2) + layout.l1 * np.abs(outputs[1]).sum() / len(x)

    _, gradient = layout.loss_and_gradient(flat, x)
    for i in rng.choice(layout.length(), 25, replace=False):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert gradient[i] == pytest.approx((objective(flat + step) - objective(flat - step)) / 2e-6, abs=1e-6)


def by_hash(df, seed=autoencoder.WEIGHT_SEED):
    rows = df.toPandas()
    order = rows["id"].map(lambda i: hashlib.md5(f"{seed}|{i}".encode()).hexdigest()).argsort()
    return rows[NAMES].to_numpy()[order.to_numpy()]


def one_process(x, held, layout, epochs, batch):
    """The same training in one process: state and loss history."""
    state, history = network.Adam(layout.initial(autoencoder.WEIGHT_SEED)), []
    for _ in range(epochs):
        total = 0.0
        for at in range(0, len(x), batch):
            loss, gradient = layout.loss_and_gradient(state.flat, x[at : at + batch])
            state.step(gradient)
            total += loss * len(x[at : at + batch])
        history.append((total / len(x), float(((layout.predict(state.flat, held) - held) ** 2).mean())))
    return state.flat, history


@pytest.mark.parametrize("workers", [1, 3, 8])
def test_synchronous_training_equals_one_process(spark, clusters, workers):
    benign = clusters.where("malware_label = 0")
    x, layout = by_hash(benign), autoencoder.bottleneck_layout(8, (16, 4, 16))
    cut = int(len(x) * 0.95)
    flat, history = one_process(x[:cut], x[cut:], layout, 5, 32)
    model = autoencoder.fit_autoencoder(benign, NAMES, "id", layout, epochs=5, workers=workers, job_epochs=3)
    assert np.abs(model.flat - flat).max() < 1e-6
    assert [e for e, *_ in model.history] == [1, 2, 3, 4, 5]
    assert np.allclose([h[1:] for h in model.history], history)


def test_training_with_given_validation_rows(spark, clusters):
    layout = autoencoder.deep_layout(8, 2)
    train, valid = clusters.where("id % 4 > 0"), clusters.where("id % 4 = 0")
    flat, history = one_process(by_hash(train), by_hash(valid), layout, 2, 128)
    model = autoencoder.fit_autoencoder(train, NAMES, "id", layout, valid, epochs=2, batch_size=128, workers=2)
    assert np.abs(model.flat - flat).max() < 1e-6 and np.allclose([h[1:] for h in model.history], history)


def test_few_rows_for_many_workers(spark, clusters):
    few = clusters.where("malware_label = 0").limit(5)
    model = autoencoder.fit_autoencoder(few, NAMES, "id", autoencoder.bottleneck_layout(8, (4,)), epochs=2, workers=4)
    assert len(model.history) == 2 and np.isfinite(model.flat).all()
    with pytest.raises(ValueError):
        autoencoder.fit_autoencoder(clusters.where("false"), NAMES, "id", autoencoder.bottleneck_layout(8, (4,)), epochs=1)


def test_autoencoder_repeats_and_flags(spark, clusters):
    benign = clusters.where("malware_label = 0")
    fit = lambda df: autoencoder.fit_autoencoder(df, NAMES, "id", autoencoder.bottleneck_layout(8, (16, 4, 16)), epochs=40)
    model, again = fit(benign), fit(benign.repartition(7))
    assert np.allclose(model.flat, again.flat)
    losses = [r.loss for r in model.loss_history(spark).orderBy("epoch").collect()]
    assert losses[-1] < losses[0] and len(losses) == 40
    assert all(r.val_loss is not None for r in model.loss_history(spark).collect())
    scored, _ = autoencoder.autoencoder_scores(clusters, NAMES, "id", model=model)
    assert roc_auc(scored, "loss_mae", "malware_label").first()[0] > 0.9
    path = scratch_path(spark, "ae")
    model.save(spark, path)
    loaded = autoencoder.Autoencoder.load(spark, path)
    assert np.allclose(loaded.flat, model.flat)
    again, _ = autoencoder.autoencoder_scores(clusters, NAMES, "id", model=loaded)
    x = clusters.select(*NAMES).toPandas().to_numpy()
    limit = 3 * abs(np.abs(model.layout.predict(model.flat, x)).mean() - np.abs(x).mean())
    assert again.first().threshold == pytest.approx(limit) and again.count() == 400
    whole = model.reconstruct(clusters.where("id < 5")).select("predicted", F.array(*NAMES).alias("x")).toPandas()
    assert np.allclose(np.stack(whole["predicted"]), model.layout.predict(model.flat, np.stack(whole["x"])))


def test_pca_matches_the_decomposition(clusters):
    got = reduction.pca(clusters, NAMES, 3, keep=["id"]).toPandas().sort_values("id")
    x = clusters.toPandas().sort_values("id")[NAMES].to_numpy()
    x = (x - x.min(0)) / (x.max(0) - x.min(0))
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    for i in range(3):
        sign = np.sign(vt[i, np.argmax(np.abs(vt[i]))])
        assert np.allclose(got[f"pc{i + 1}"], sign * u[:, i] * s[i], atol=1e-8)
    curve = reduction.explained_variance_curve(clusters, NAMES).toPandas().sort_values("component")
    assert np.allclose(curve["ratio"], s**2 / (s**2).sum()) and curve["cumulative"].iloc[-1] == pytest.approx(1.0)


def test_forest_finds_the_signal(clusters):
    noisy = clusters.select("id", "malware_label", "x0", *[F.rand(i).alias(f"n{i}") for i in range(3)])
    names = ["x0", "n0", "n1", "n2"]
    ranks = {r.feature: r.importance for r in reduction.forest_importances(noisy, names, trees=10, max_depth=4).collect()}
    assert max(ranks, key=ranks.get) == "x0" and sum(ranks.values()) == pytest.approx(1.0)
    kept = reduction.forest_select(noisy, names, trees=10, max_depth=4, row_id="id", limit=0.5)
    assert kept.columns == ["malware_label", "x0"]


def test_random_projection_repeats(clusters):
    once = reduction.random_projection(clusters, NAMES, 3, keep=["id"]).toPandas().sort_values("id")
    twice = reduction.random_projection(clusters.repartition(5), NAMES, 3, keep=["id"]).toPandas().sort_values("id")
    assert np.allclose(once, twice) and (once[["f1", "f2", "f3"]] >= 0).all().all()


def test_gram(clusters):
    x = clusters.select(*NAMES).toPandas().to_numpy()
    ones = np.column_stack([np.ones(len(x)), x])
    assert np.allclose(gram_matrix(clusters, NAMES), ones.T @ ones)


def test_deep_autoencoder_report(clusters):
    report = autoencoder.deep_autoencoder(clusters, NAMES, "id", 2, epochs=40, workers=2)
    assert report.scored.count() == 64 and report.auc.first()[0] > 0.9
    errors = {r.malware_label: r for r in report.errors.collect()}
    cells = {(r.label, r.prediction): r.n for r in report.confusion.collect()}
    assert errors[1].mean_loss > errors[0].mean_loss
    assert sum(cells.values()) == 64 and cells[1, 1] == errors[1].anomalies and cells[0, 1] == errors[0].anomalies


def test_cross_validation(clusters):
    fit = lambda part: kernel.fit_svm(part, NAMES, components=64, probability=False, max_iter=10)
    scores = train.cross_validate(clusters, "id", fit, folds=2).first()
    assert scores.accuracy > 0.95 and scores.recall > 0.9 and 0 < scores.f_beta <= 1


def test_small_steps_take_one_worker():
    """An exchange of gradients costs more than a mini-batch of 32 rows, however many rows there are."""
    layout = autoencoder.bottleneck_layout(64)
    assert autoencoder.default_workers(layout, autoencoder.BATCH, 12) == 1
    assert autoencoder.default_workers(autoencoder.deep_layout(64, 4), autoencoder.DEEP_BATCH, 12) == 1
    assert 2 <= autoencoder.default_workers(layout, 4096, 12) < autoencoder.default_workers(layout, 65536, 12) == 12


def test_landmark_features_need_no_room_beside_themselves():
    rng = np.random.default_rng(1)
    basis, x = kernel.Basis(rng.random((256, 8)), 0.1), rng.random((20_000, 8))
    tracemalloc.start()
    z = basis(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * z.nbytes
    assert np.allclose(z, kernel.gaussian(x, basis.landmarks, 0.1) @ basis.root, rtol=1e-12, atol=1e-9)


def test_folds_are_fitted_at_the_same_time(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(40)], "id bigint, malware_label int")
    both = threading.Barrier(2, timeout=60)

    class Model:
        def transform(self, part):
            return part.withColumn("prediction", F.col("malware_label").cast("double"))

    def fit(part):
        both.wait()
        return Model()

    assert train.cross_validate(rows, "id", fit, 2).first()["accuracy"] == 1.0


def test_members_of_a_team_equal_one_process(spark, clusters, monkeypatch):
    """More members than some layers have rows, a last mini-batch with fewer rows than members, and penalties."""
    counts = []
    benign = clusters.where("malware_label = 0")
    x = by_hash(benign)
    cut = int(len(x) * 0.95)
    monkeypatch.setattr(autoencoder, "tasks_for", lambda spark, members: counts.append(members) or members)
    for layout, members in ((autoencoder.bottleneck_layout(8, (16, 4, 16)), 4), (autoencoder.deep_layout(8, 2), 3), (network.Layout((8, 3, 8), ("elu", "relu"), 1e-3), 7)):
        flat, history = one_process(x[:cut], x[cut:], layout, 5, 32)
        model = autoencoder.fit_autoencoder(benign, NAMES, "id", layout, epochs=5, job_epochs=3, workers=1, members=members)
        assert np.abs(model.flat - flat).max() < 1e-6 and np.allclose([h[1:] for h in model.history], history)
    assert counts == [4, 3, 7]


def test_tasks_of_one_host_share_memory(spark):
    folder = scratch_path(spark, "team")
    pathlib.Path(folder).mkdir(parents=True)

    def task(batches):
        own = team.Team(folder, 3, 4)
        if own.rank is not None:
            own.room[own.rank] = 10.0 + own.rank
            own.meet()
            yield pa.RecordBatch.from_pydict({"rank": [own.rank], "seen": [own.room[:3].tolist()]})

    rows = spark.range(0, 5, 1, 5).mapInArrow(task, "rank long, seen array<double>", barrier=True).collect()
    assert sorted(r["rank"] for r in rows) == [0, 1, 2] and all(r["seen"] == [10.0, 11.0, 12.0] for r in rows)
    assert not list(pathlib.Path(folder).iterdir())  # nothing stays behind


def test_bottleneck_network_is_trained_by_a_team():
    assert autoencoder.default_members(autoencoder.bottleneck_layout(64), autoencoder.BATCH) == 4
    assert autoencoder.default_members(autoencoder.deep_layout(64, 4), autoencoder.DEEP_BATCH) == 1
    assert autoencoder.default_members(autoencoder.bottleneck_layout(64), 5) == 1
    assert team.chosen(["a:1", "b:1", "b:2", "c:1", "b:3", "c:2"], 2) == [1, 2]
    assert team.chosen(["a:1", "b:1"], 4) == [0]


@pytest.mark.parametrize("name", ["autoencoder_saved", "autoencoder_score"])
def test_query_trains_in_a_team(spark, monkeypatch, name):
    """The registered query asks for a team of its own accord, and gets what one process gives."""
    asked, tasks = [], autoencoder.tasks_for
    monkeypatch.setattr(model_queries, "EPOCHS", 2)
    monkeypatch.setattr(autoencoder, "tasks_for", lambda spark, members: asked.append(members) or tasks(spark, members))
    run = lambda: {r.vec_id: r for r in model_queries.MODELS[name].run(spark, "/root/testdata/sf0.001").collect()}
    shared = run()
    monkeypatch.setattr(autoencoder, "default_members", lambda layout, batch_size: 1)
    alone = run()
    assert asked == [4, 1] and shared.keys() == alone.keys() and len(shared) > 300
    for key, row in shared.items():
        assert row.loss_mae == pytest.approx(alone[key].loss_mae, abs=1e-9) and row.anomaly == alone[key].anomaly
        assert row.threshold == pytest.approx(alone[key].threshold, abs=1e-9)
