import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowscope.operators import columns, evaluate, ordered, profile, sampling, summary, variance
from flowscope.session import materialized


@pytest.fixture(scope="module")
def table(spark):
    """2,000 rows; a third share one score, columns of several shapes, a constant and a zero column."""
    rng = np.random.default_rng(5)
    n = 2000
    score = np.round(rng.normal(size=n), 2)
    score[::3] = 0.25
    label = (rng.random(n) < 0.3).astype(int)
    rows = [
        (int(i), int(label[i]), float(score[i]), float(rng.normal() * (1 + label[i])), float(rng.integers(0, 5)), 7.0, 0.0)
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "id long, malware_label int, score double, a double, b double, c double, z double")
    return df.repartition(5).cache()


@pytest.fixture(scope="module")
def local(table):
    return table.toPandas().sort_values("id").reset_index(drop=True)


FEATURES = ["score", "a", "b", "c", "z"]


def test_summary_paths_agree(table, monkeypatch):
    order = ["malware_label", "feature"]
    narrow = summary.summarize(table, FEATURES, ["malware_label"]).toPandas().sort_values(order)
    monkeypatch.setattr(summary, "NARROW", 0)
    wide = summary.summarize(table, FEATURES, ["malware_label"]).toPandas().sort_values(order)
    assert np.allclose(narrow[summary.MEASURES].to_numpy(float), wide[summary.MEASURES].to_numpy(float))


def test_scalers(table, local):
    scaled = summary.minmax_scale(table, FEATURES).toPandas().sort_values("id")
    assert scaled[FEATURES].min().min() >= 0 and scaled[FEATURES].max().max() <= 1
    assert (scaled["c"] == 0).all() and (scaled["z"] == 0).all()
    z = summary.zscore(table, ["a", "c"]).toPandas().sort_values("id")
    assert np.allclose(z["a"], (local["a"] - local["a"].mean()) / local["a"].std()) and z["c"].isna().all()
    s = summary.standard_scale(table, ["a", "c"], columns.filter_class(table, 0)).toPandas().sort_values("id")
    fit = local[local.malware_label == 0]["a"]
    assert np.allclose(s["a"], (local["a"] - fit.mean()) / fit.std(ddof=0)) and (s["c"] == 0).all()


def test_prune(table):
    assert summary.prune_zero_columns(table, FEATURES).columns == ["id", "malware_label", "score", "a", "b", "c"]


def test_recode_is_simultaneous(spark):
    df = spark.createDataFrame([(0,), (1,)], "malware_label int")
    there = columns.recode_label(df, columns.ONE_CLASS)
    assert [r[0] for r in there.collect()] == [1, -1]
    assert [r[0] for r in columns.recode_label(there, columns.BINARY).collect()] == [0, 1]


def test_exact_sample_does_not_depend_on_partitions(table):
    one = {r.id for r in sampling.sample_n(table, "id", 321).collect()}
    two = {r.id for r in sampling.sample_n(table.repartition(17), "id", 321).collect()}
    assert len(one) == 321 and one == two
    assert {r.id for r in sampling.sample_n(table, "id", 321, seed=7).collect()} != one
    assert sampling.sample_n(table, "id", 10**6).count() == 2000 and sampling.sample_n(table, "id", 0).count() == 0


@pytest.mark.parametrize("size,percent,one_class", [(500, 20.0, False), (100000, 90.0, False), (500, 20.0, True), (333, 1.0, False)])
def test_class_ratio(table, local, size, percent, one_class):
    malware, benign = (local.malware_label == 1).sum(), (local.malware_label == 0).sum()
    base = int(0.2 * size) if one_class else size
    want = min(int(percent / 100 * base), malware)
    got = sampling.class_ratio_sample(table, "id", "malware_label", size, percent, 20.0 if one_class else None)
    counts = {r.malware_label: r["count"] for r in got.groupBy("malware_label").count().collect()}
    assert counts.get(1, 0) == want and counts.get(0, 0) == min(size - want, benign)


def test_splits_partition_the_rows(table):
    split = sampling.three_way_split(table, "id").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split} == {"test": 400, "valid": 320, "train": 1280}
    folds = sampling.kfold(table, "id", 7, by="malware_label")
    assert folds.count() == 2000
    sizes = [r["count"] for r in folds.groupBy("malware_label", "fold").count().where("malware_label = 1").collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1


def test_one_class_split(table, local):
    split = sampling.one_class_split(table, "id", "malware_label", benign=0)
    train = split.where("split = 'train'")
    assert train.where("malware_label = 1").count() == 0
    assert train.count() == (local.malware_label == 0).sum() - math.ceil((local.malware_label == 0).sum() * 0.2)


@pytest.mark.parametrize("buckets", [1, 5, 50, 5000])
def test_ordered_with_a_hot_value(table, local, buckets):
    by = local.sort_values(["score", "id"]).reset_index(drop=True)
    ids = ordered.row_ids(table, ["score", "id"], "place", buckets).toPandas().sort_values("place")
    assert ids["id"].tolist() == by["id"].tolist() and ids["place"].tolist() == list(range(2000))
    total = ordered.cumulative_sum(table, ["score", "id"], "b", "total", buckets).toPandas().sort_values(["score", "id"])
    assert np.allclose(total["total"], by["b"].cumsum())


def test_hot_value_is_cut_further(table):
    sizes = ordered.range_buckets(table, ["score", "id"], 12).groupBy(ordered.BUCKET).count().toPandas()
    assert sizes["count"].max() < 2000 / 6


def brute_roc(local):
    points, p = [], local.malware_label.sum()
    for threshold in sorted(local.score.unique(), reverse=True):
        above = local[local.score >= threshold]
        points.append((threshold, (above.malware_label == 0).sum() / (len(local) - p), above.malware_label.sum() / p))
    return points


@pytest.mark.parametrize("buckets", [1, 9, 5000])
def test_roc(table, local, buckets):
    expected = brute_roc(local)
    full = evaluate.roc_curve(table, "score", "malware_label", drop_intermediate=False, buckets=buckets).collect()
    assert np.allclose(sorted(map(tuple, full)), sorted(expected))
    kept = sorted(map(tuple, evaluate.roc_curve(table, "score", "malware_label", buckets=buckets).collect()), reverse=True)
    counts = local.groupby("score").malware_label.agg(["sum", "count"]).sort_index(ascending=False)
    pos, neg = counts["sum"].tolist(), (counts["count"] - counts["sum"]).tolist()
    last = len(pos) - 1
    want = [e for i, e in enumerate(expected) if i in (0, last) or pos[i + 1] != pos[i] or neg[i + 1] != neg[i]]
    assert len(kept) == len(want) and np.allclose(kept, want)


def test_auc(table, local):
    pos, neg = local[local.malware_label == 1].score.to_numpy(), local[local.malware_label == 0].score.to_numpy()
    expected = ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2)
    assert evaluate.roc_auc(table, "score", "malware_label").first()[0] == pytest.approx(expected)
    hard = table.withColumn("hit", (F.col("score") > 0.3).cast("double"))
    scores = evaluate.classification_scores(hard.withColumn("hit", F.col("hit").cast("int")), "malware_label", "hit").first()
    tnr = ((local.score <= 0.3) & (local.malware_label == 0)).sum() / (local.malware_label == 0).sum()
    assert evaluate.roc_auc(hard, "hit", "malware_label").first()[0] == pytest.approx((scores.recall + tnr) / 2)


def test_pr_stops_at_full_recall(table, local):
    rows = evaluate.pr_curve(table, "score", "malware_label").toPandas().sort_values("threshold")
    assert rows["recall"].iloc[0] == 1.0 and (rows["recall"] == 1.0).sum() == 1
    assert rows["threshold"].min() == local[local.malware_label == 1].score.min()


def test_confusion_has_all_cells(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, prediction int")
    got = {(r.label, r.prediction): r.n for r in evaluate.confusion_matrix(df, "label", "prediction").collect()}
    assert got == {(0, 0): 2, (0, 1): 0, (1, 0): 1, (1, 1): 0}
    scores = evaluate.classification_scores(df, "label", "prediction").first()
    assert (scores.precision, scores.recall, scores.f_beta) == (0.0, 0.0, 0.0)
    benign = evaluate.classification_scores(df, "label", "prediction", positive=0).first()
    assert benign.recall == 1.0 and benign.precision == pytest.approx(2 / 3)


def test_medians(table, local):
    long = variance.unpivot_features(table, FEATURES, ["malware_label"])
    for r in variance.exact_median(long, ["malware_label", "feature"]).collect():
        assert r["median"] == pytest.approx(local[local.malware_label == r.malware_label][r.feature].median())


def test_equal_variance(table, local):
    groups = [g["a"].to_numpy() for _, g in local.groupby("malware_label")]
    n, k = sum(map(len, groups)), 2
    v = [g.var(ddof=1) for g in groups]
    pooled = sum((len(g) - 1) * s for g, s in zip(groups, v)) / (n - k)
    t = ((n - k) * math.log(pooled) - sum((len(g) - 1) * math.log(s) for g, s in zip(groups, v))) / (
        1 + (sum(1 / (len(g) - 1) for g in groups) - 1 / (n - k)) / (3 * (k - 1))
    )
    got = {r.feature: r for r in variance.bartlett(table, FEATURES).collect()}
    assert got["a"].t == pytest.approx(t) and got["a"].equal_var is False and got["c"].t is None
    z = [abs(g - np.median(g)) for g in groups]
    mean = np.concatenate(z).mean()
    w = (n - k) * sum(len(x) * (x.mean() - mean) ** 2 for x in z) / ((k - 1) * sum(((x - x.mean()) ** 2).sum() for x in z))
    lev = {r.feature: r for r in variance.levene(table, FEATURES).collect()}
    assert lev["a"].w == pytest.approx(w) and lev["a"].p < 1e-6 and lev["z"].w is None


def test_correlation(table, local):
    got = {(r.f1, r.f2): r.r for r in profile.corr_matrix(table, ["score", "a", "c"]).collect()}
    assert got["score", "a"] == pytest.approx(local["score"].corr(local["a"])) and got["c", "c"] is None and got["a", "c"] is None


def test_vif(table, local):
    names = ["score", "a", "b", "c"]
    got = {r.feature: r.vif for r in profile.vif(table, [*names, "z"]).collect()}
    x = local[names].to_numpy()
    for i, name in enumerate(names):
        others = np.delete(x, i, axis=1)
        fit = others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        centre = x[:, i].mean() if name != "c" else 0.0
        assert got[name] == pytest.approx(((x[:, i] - centre) ** 2).sum() / ((x[:, i] - fit) ** 2).sum())
    assert got["z"] is None
    twin = table.withColumn("a2", F.col("a") * 2)
    assert {r.vif for r in profile.vif(twin, ["a", "a2"]).collect()} == {float("inf")}


def test_histogram(table, local):
    rows = profile.histogram(table, ["a", "c"], bins=40).collect()
    counts = np.zeros(40)
    for r in rows:
        if r.feature == "a":
            counts[r.bin] = r.n
    assert counts.tolist() == np.histogram(local["a"], bins=40)[0].tolist()
    assert [(r.bin, r.n) for r in rows if r.feature == "c"] == [(20, 2000)]


def test_median_of_continuous_and_hot_values(spark):
    rng = np.random.default_rng(9)
    x = rng.lognormal(size=20001)
    y = np.where(np.arange(20001) % 3 == 0, 1.5, x)
    df = spark.createDataFrame([("x", float(v)) for v in x] + [("y", float(v)) for v in y], "feature string, value double")
    got = {r.feature: r["median"] for r in variance.exact_median(df, ["feature"]).collect()}
    assert got == {"x": np.median(x), "y": np.median(y)}


def test_exact_sizes_where_ids_repeat(spark):
    rows = materialized(spark.range(4000).selectExpr("id div 2 AS id", "cast(id % 3 = 0 AS int) AS malware_label").union(spark.sql("SELECT 7L, 0 FROM range(3000)")), "twice")
    assert sampling.sample_n(rows, "id", 101).count() == 101
    assert sampling.train_test_split(rows, "id").groupBy("split").count().collect() and sampling.train_test_split(rows, "id").where("split = 'test'").count() == 1400
    parts = {r.split: r["count"] for r in sampling.three_way_split(rows, "id").groupBy("split").count().collect()}
    assert parts == {"test": 1400, "valid": 1120, "train": 4480}
    drawn = {r.malware_label: r["count"] for r in sampling.class_ratio_sample(rows, "id", "malware_label", 500, 25.0).groupBy("malware_label").count().collect()}
    assert drawn == {0: 375, 1: 125}
    folds = [r["count"] for r in sampling.kfold(rows, "id", 7).groupBy("fold").count().collect()]
    assert len(folds) == 7 and sum(folds) == 7000 and max(folds) - min(folds) <= 1
    kept = sampling.downsample_class(rows, "id", "malware_label", 10.0)
    benign = rows.where("malware_label = 0").count()
    assert kept.where("malware_label = 0").count() == benign // 10
    assert sorted(sampling.sample_n(rows, "id", 50).columns) == ["id", "malware_label"]
