"""Profiling, sampling and evaluation over numeric tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowscope.detectors.kernel import score_grid as grid
from flowscope.operators import columns, evaluate, ordered, profile, sampling, summary, variance
from flowscope.sources.tables import preview
from flowscope.workload import fixtures as fx
from flowscope.workload.fixtures import FEATURES, LIVE, Registry, table, view, with_views

TABLES = Registry()
WITH = with_views("feature_table")
LABEL = "malware_label"


def features(spark, sf):
    return view(spark, sf, "feature_table")


def rounded(df, names, places=6):
    names = {names} if isinstance(names, str) else set(names)
    return df.select(*[F.round(c, places).alias(c) if c in names else F.col(c) for c in df.columns])


# --- projections and predicates --------------------------------------------------------------------
@TABLES.add("split_features", WITH + f" SELECT row_id, {', '.join(FEATURES)} FROM feature_table")
def split_features(spark, sf):
    return columns.split_features(features(spark, sf))[0]


@TABLES.add("select_prefix", WITH + " SELECT row_id, l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber FROM feature_table")
def select_prefix(spark, sf):
    return columns.select_prefix(features(spark, sf), "l_", ["row_id"])


@TABLES.add("column_window", WITH + f" SELECT row_id, malware_label, {', '.join(FEATURES[3:6])} FROM feature_table")
def column_window(spark, sf):
    return columns.column_window(features(spark, sf), 1, 3, ["row_id", LABEL])


@TABLES.add("keep_columns", WITH + " SELECT row_id, l_tax, l_quantity FROM feature_table")
def keep_columns(spark, sf):
    return columns.keep_columns(features(spark, sf), ["l_tax", "l_quantity"], ["row_id"])


@TABLES.add("prune_zero_columns", WITH + f" SELECT row_id, malware_label, {', '.join(FEATURES[:6])} FROM feature_table")
def prune_zero_columns(spark, sf):
    return summary.prune_zero_columns(features(spark, sf), FEATURES)


@TABLES.add("filter_class", WITH + " SELECT * FROM feature_table WHERE malware_label = 1")
def filter_class(spark, sf):
    return columns.filter_class(features(spark, sf), 1)


@TABLES.add("recode_label", "SELECT doc_id, CASE toxic WHEN 0 THEN 1 WHEN 1 THEN -1 END AS toxic FROM labels")
def recode_label(spark, sf):
    return columns.recode_label(table(spark, sf, "labels").select("doc_id", "toxic"), columns.ONE_CLASS, "toxic")


@TABLES.add("anomaly_flag", WITH + " SELECT row_id, l_discount, l_discount > 0.055 AS anomaly FROM feature_table")
def anomaly_flag(spark, sf):
    return columns.anomaly_flag(features(spark, sf).select("row_id", "l_discount"), "l_discount", 0.055)


@TABLES.add(
    "zip_columns",
    """SELECT a.o_orderkey, a.o_totalprice, b.o_orderpriority FROM orders a JOIN orders b USING (o_orderkey)""",
)
def zip_columns(spark, sf):
    orders = table(spark, sf, "orders")
    return columns.zip_columns(orders.select("o_orderkey", "o_totalprice"), orders.select("o_orderkey", "o_orderpriority"), "o_orderkey")


@TABLES.add("row_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_id FROM orders")
def row_ids(spark, sf):
    """Dense ids in price order."""
    return ordered.row_ids(table(spark, sf, "orders"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "row_id")


@TABLES.add("print_rows", "SELECT n_nationkey, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers FROM nation ORDER BY customers DESC, n_nationkey LIMIT 10")
def print_rows(spark, sf):
    """The rows a terminal shows of a report."""
    counts = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    report = table(spark, sf, "nation").join(counts, "n_nationkey", "left").fillna(0, ["customers"])
    return preview(report.select("n_nationkey", "n_name", "customers").orderBy(F.desc("customers"), "n_nationkey"), 10)


# --- scaling and statistics ------------------------------------------------------------------------
def _scale_sql(expression: str) -> str:
    columns_sql = ", ".join(f"round({expression.format(c=c)}, 6) AS {c}" for c in FEATURES)
    stats = ", ".join(
        f"{fn}({c}) AS {c}_{fn}" for c in FEATURES for fn in ("min", "max", "avg", "stddev_samp")
    )
    return WITH + f", s AS (SELECT {stats} FROM feature_table) SELECT row_id, malware_label, {columns_sql} FROM feature_table, s"


@TABLES.add(
    "minmax_scale",
    _scale_sql("CASE WHEN {c}_max = {c}_min THEN 0.0 ELSE ({c} - {c}_min) / ({c}_max - {c}_min) END"),
)
def minmax_scale(spark, sf):
    return rounded(summary.minmax_scale(features(spark, sf), FEATURES), FEATURES)


@TABLES.add("zscore", _scale_sql("CASE WHEN {c}_stddev_samp = 0 THEN NULL ELSE ({c} - {c}_avg) / {c}_stddev_samp END"))
def zscore(spark, sf):
    return rounded(summary.zscore(features(spark, sf), FEATURES), FEATURES)


FIT_SQL = ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in FEATURES)


@TABLES.add(
    "standard_scale_fit_on",
    WITH
    + f", s AS (SELECT {FIT_SQL} FROM feature_table WHERE malware_label = 0) SELECT row_id, malware_label, "
    + ", ".join(f"round(({c} - {c}_m) / CASE WHEN {c}_s = 0 THEN 1 ELSE {c}_s END, 6) AS {c}" for c in FEATURES)
    + " FROM feature_table, s",
)
def standard_scale_fit_on(spark, sf):
    """Fitted on the benign rows, applied to all."""
    rows = features(spark, sf)
    return rounded(summary.standard_scale(rows, FEATURES, columns.filter_class(rows, 0)), FEATURES)


@TABLES.add(
    "class_distribution",
    WITH
    + """ SELECT malware_label, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM feature_table), 0)::DOUBLE AS percent
      FROM feature_table GROUP BY malware_label""",
)
def class_distribution(spark, sf):
    return profile.class_distribution(features(spark, sf))


CORR = [*FEATURES, LABEL]
CORR_SQL = ", ".join(
    f"(CASE WHEN stddev_pop({a}) = 0 OR stddev_pop({b}) = 0 THEN NULL ELSE corr({a}, {b}) END) AS c{i}_{j}"
    for i, a in enumerate(CORR)
    for j, b in enumerate(CORR)
    if i <= j
)
CORR_ROWS = " UNION ALL ".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, round(c{min(i, j)}_{max(i, j)}, 6) AS r FROM m"
    for i, a in enumerate(CORR)
    for j, b in enumerate(CORR)
)


@TABLES.add("corr_matrix", WITH + f", m AS (SELECT {CORR_SQL} FROM feature_table) {CORR_ROWS}")
def corr_matrix(spark, sf):
    return rounded(profile.corr_matrix(features(spark, sf), CORR), "r")


VIF = LIVE[:3]
G = {(i, j): f"g{min(i, j)}{max(i, j)}" for i in range(3) for j in range(3)}
VIF_SUMS = ", ".join(f"sum({VIF[i]} * {VIF[j]}) AS g{i}{j}" for i in range(3) for j in range(3) if i <= j)


def _vif_row(i: int) -> str:
    j, k = [x for x in range(3) if x != i]
    inner = f"({G[j, j]} * {G[k, k]} - {G[j, k]} * {G[j, k]})"
    explained = (
        f"(({G[i, j]} * {G[i, j]} * {G[k, k]} - 2 * {G[i, j]} * {G[i, k]} * {G[j, k]} + {G[i, k]} * {G[i, k]} * {G[j, j]}) / {inner})"
    )
    return f"SELECT '{VIF[i]}' AS feature, round({G[i, i]} / ({G[i, i]} - {explained}), 5) AS vif FROM g"


@TABLES.add("vif", WITH + f", g AS (SELECT {VIF_SUMS} FROM feature_table) " + " UNION ALL ".join(_vif_row(i) for i in range(3)))
def vif(spark, sf):
    return rounded(profile.vif(features(spark, sf), VIF), "vif", 5)


def _unpivot(aggregate: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round({aggregate.format(c=c, v=0)}, 2) AS benign, round({aggregate.format(c=c, v=1)}, 2) AS malware FROM feature_table"
        for c in FEATURES
    )


@TABLES.add("class_column_sums", WITH + " " + _unpivot("sum({c}) FILTER (WHERE malware_label = {v})"))
def class_column_sums(spark, sf):
    return rounded(profile.class_column_sums(features(spark, sf), FEATURES), ["benign", "malware"], 2)


@TABLES.add("class_means", WITH + " " + _unpivot("avg({c}) FILTER (WHERE malware_label = {v})"))
def class_means(spark, sf):
    return rounded(profile.class_means(features(spark, sf), FEATURES), ["benign", "malware"], 2)


def _histogram_sql(source: str, bins: int, names=FEATURES, by: str = "malware_label, ") -> str:
    parts = " UNION ALL ".join(
        f"""SELECT {by}'{c}' AS feature, CAST(least(floor(({c} - lo) / ((hi - lo) / {bins}.0)), {bins - 1}) AS INTEGER) AS bin
        FROM {source}, (SELECT CASE WHEN min({c}) = max({c}) THEN min({c}) - 0.5 ELSE min({c}) END AS lo,
        CASE WHEN min({c}) = max({c}) THEN max({c}) + 0.5 ELSE max({c}) END AS hi FROM feature_table)"""
        for c in names
    )
    return f"SELECT {by}feature, bin, count(*) AS n FROM ({parts}) GROUP BY ALL"


HALF_BENIGN = """drawn AS (SELECT * EXCLUDE (rn, nb) FROM (SELECT *, row_number() OVER (PARTITION BY malware_label
    ORDER BY md5(concat('42|', row_id))) AS rn, count(*) OVER (PARTITION BY malware_label) AS nb FROM feature_table)
  WHERE malware_label = 1 OR rn <= trunc(nb * 0.5)::BIGINT)"""


@TABLES.add("class_histogram", WITH + f", {HALF_BENIGN} " + _histogram_sql("drawn", 40))
def class_histogram(spark, sf):
    """40 bins per feature and class, half of the benign rows."""
    return profile.class_histogram(features(spark, sf), FEATURES, "row_id", benign_percent=50.0)


@TABLES.add("loss_histogram", WITH + " " + _histogram_sql("feature_table", 10, ["l_discount"], by=""))
def loss_histogram(spark, sf):
    return profile.histogram(features(spark, sf), ["l_discount"], bins=10)


BARTLETT_PARTS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) - 1 AS d, var_samp({c}) AS v FROM feature_table GROUP BY malware_label" for c in LIVE
)


@TABLES.add(
    "bartlett",
    WITH
    + f""", g AS ({BARTLETT_PARTS}), s AS (SELECT feature, count(*) AS k, sum(d) AS d, sum(d * v) AS ss, sum(d * ln(v)) AS lv,
      sum(1.0 / d) AS inv FROM g GROUP BY feature)
      SELECT feature, round((d * ln(ss / d) - lv) / (1 + (inv - 1.0 / d) / (3 * (k - 1))), 5) AS t FROM s""",
)
def bartlett(spark, sf):
    return rounded(variance.bartlett(features(spark, sf), LIVE).select("feature", "t"), "t", 5)


LEVENE_PARTS = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, malware_label, abs({c} - median({c}) OVER (PARTITION BY malware_label)) AS z FROM feature_table"""
    for c in LIVE
)


@TABLES.add(
    "levene",
    WITH
    + f""", z AS ({LEVENE_PARTS}), g AS (SELECT feature, malware_label, count(*) AS n, avg(z) AS m, var_pop(z) AS v FROM z GROUP BY ALL),
      s AS (SELECT feature, count(*) AS k, sum(n) AS n, sum(n * v) AS inside, sum(n * m) AS t, sum(n * m * m) AS q FROM g GROUP BY feature)
      SELECT feature, round((n - k) * (q - t * t / n) / ((k - 1) * inside), 4) AS w FROM s""",
)
def levene(spark, sf):
    return rounded(variance.levene(features(spark, sf), LIVE).select("feature", "w"), "w", 4)


@TABLES.add("factor_analysis")
def factor_analysis(spark, sf):
    """Both tests with p-values for the features whose classes have equal variance."""
    return variance.factor_analysis(features(spark, sf), LIVE)


@TABLES.add(
    "exact_median",
    WITH + " " + " UNION ALL ".join(f"SELECT malware_label, '{c}' AS feature, median({c}) AS median FROM feature_table GROUP BY malware_label" for c in LIVE),
)
def exact_median(spark, sf):
    return variance.exact_median(variance.unpivot_features(features(spark, sf), LIVE, [LABEL]), [LABEL, "feature"])


@TABLES.add(
    "active_columns",
    WITH
    + " SELECT malware_label, "
    + " + ".join(f"CAST(max({c}) <> 0 OR min({c}) <> 0 AS BIGINT)" for c in FEATURES)
    + " AS active FROM feature_table GROUP BY malware_label",
)
def active_columns(spark, sf):
    return profile.active_columns(features(spark, sf), FEATURES)


@TABLES.add(
    "distinct_ratio",
    "SELECT event_type, round(count(DISTINCT user_id) / count(*), 6) AS ratio FROM events GROUP BY event_type",
)
def distinct_ratio(spark, sf):
    return rounded(profile.distinct_ratio(table(spark, sf, "events"), "user_id", "event_type"), "ratio")


@TABLES.add("top_values", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def top_values(spark, sf):
    return profile.top_values(table(spark, sf, "events"), "user_id")


@TABLES.add(
    "cumulative_sum",
    "SELECT p_partkey, p_retailprice, round(sum(p_retailprice) OVER (ORDER BY p_retailprice, p_partkey), 2) AS cumulative FROM part",
)
def cumulative_sum(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return rounded(ordered.cumulative_sum(parts, ["p_retailprice", "p_partkey"], "p_retailprice"), "cumulative", 2)


@TABLES.add("top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
def top_k(spark, sf):
    return ordered.top_k(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 50, ["p_partkey"])


@TABLES.add("last_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 20")
def last_k(spark, sf):
    return ordered.top_k(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 20, ["p_partkey"], largest=False)


@TABLES.add(
    "select_by_importance",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_tax FROM lineitem WHERE round(l_tax, 2) >= 0.03",
)
def select_by_importance(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_tax")
    return profile.select_by_importance(lines, "l_tax")


@TABLES.add(
    "score_grid",
    """WITH b AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_discount) AS y0, max(l_discount) AS y1 FROM lineitem)
      SELECT round(x0 + i * (x1 - x0) / 29, 6) AS gx, round(y0 + j * (y1 - y0) / 29, 6) AS gy
      FROM b, range(30) r(i), range(30) q(j)""",
)
def score_grid(spark, sf):
    """30 x 30 grid over the range of two columns."""
    bounds = summary.collect_summary(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"])
    span = lambda c: (bounds[c]["low"], bounds[c]["high"])
    return rounded(grid(spark, span("l_quantity"), span("l_discount")), ["gx", "gy"])


# --- sets, samples, splits -------------------------------------------------------------------------
@TABLES.add("union_rows", "SELECT c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def union_rows(spark, sf):
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    firms = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"))
    return sampling.union_rows(people, firms)


RANKED_LABELS = """r AS (SELECT doc_id, toxic, quality, row_number() OVER (ORDER BY md5(concat('42|', doc_id))) AS rn,
    row_number() OVER (PARTITION BY toxic ORDER BY md5(concat('42|', doc_id))) AS rc, count(*) OVER () AS n,
    count(*) OVER (PARTITION BY toxic) AS nc FROM labels)"""


@TABLES.add("sample_n", "SELECT o_orderkey FROM orders ORDER BY md5(concat('42|', o_orderkey)) LIMIT 1000")
def sample_n(spark, sf):
    return sampling.sample_n(table(spark, sf, "orders"), "o_orderkey", 1000).select("o_orderkey")


@TABLES.add(
    "class_ratio_sample",
    f"""WITH {RANKED_LABELS}, q AS (SELECT least(trunc((15.0 / 100) * 200)::BIGINT, (SELECT count(*) FROM labels WHERE toxic = 1)) AS mal)
      SELECT doc_id, toxic FROM r, q WHERE (toxic = 1 AND rc <= mal) OR (toxic = 0 AND rc <= 200 - mal)""",
)
def class_ratio_sample(spark, sf):
    return sampling.class_ratio_sample(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "toxic", 200, 15.0)


@TABLES.add(
    "one_class_sample",
    f"""WITH {RANKED_LABELS}, q AS (SELECT least(trunc((40.0 / 100) * trunc((20.0 / 100) * 300))::BIGINT,
        (SELECT count(*) FROM labels WHERE toxic = 1)) AS mal)
      SELECT doc_id, CASE toxic WHEN 0 THEN 1 ELSE -1 END AS toxic FROM r, q
      WHERE (toxic = 1 AND rc <= mal) OR (toxic = 0 AND rc <= 300 - mal)""",
)
def one_class_sample(spark, sf):
    """Malware share taken of the test share; labels recoded to 1 and -1."""
    rows = columns.recode_label(table(spark, sf, "labels").select("doc_id", "toxic"), columns.ONE_CLASS, "toxic")
    return sampling.class_ratio_sample(rows, "doc_id", "toxic", 300, 40.0, 20.0, benign=1, malware=-1)


@TABLES.add(
    "downsample_class",
    f"WITH {RANKED_LABELS} SELECT doc_id, toxic FROM r WHERE toxic = 1 OR rc <= trunc(nc * 0.3)::BIGINT",
)
def downsample_class(spark, sf):
    return sampling.downsample_class(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "toxic", 30.0)


@TABLES.add(
    "train_test_split",
    """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5(concat('42|', o_orderkey))) <= ceil(count(*) OVER () * 0.2)
      THEN 'test' ELSE 'train' END AS split FROM orders""",
)
def train_test_split(spark, sf):
    return sampling.train_test_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@TABLES.add(
    "hash_split",
    "SELECT o_orderkey, CASE WHEN md5(concat('42|', o_orderkey)) < '33333333' THEN 'test' ELSE 'train' END AS split FROM orders",
)
def hash_split(spark, sf):
    return sampling.hash_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@TABLES.add(
    "three_way_split",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat('42|', o_orderkey))) AS rn, count(*) OVER () AS n FROM orders)
      SELECT o_orderkey, CASE WHEN rn <= ceil(n * 0.2) THEN 'test' WHEN rn <= ceil(n * 0.2) + ceil((n - ceil(n * 0.2)) * 0.2)
      THEN 'valid' ELSE 'train' END AS split FROM r""",
)
def three_way_split(spark, sf):
    return sampling.three_way_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@TABLES.add("shuffled", f"WITH {RANKED_LABELS} SELECT doc_id, toxic, rn - 1 AS place FROM r")
def shuffled(spark, sf):
    """Rows with their places in the seeded order that ``shuffled`` gives them."""
    return sampling.hash_rank(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", name="place")


@TABLES.add("kfold", f"WITH {RANKED_LABELS} SELECT doc_id, toxic, CAST((rc - 1) % 10 AS INTEGER) AS fold FROM r")
def kfold(spark, sf):
    return sampling.kfold(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", 10, by="toxic")


@TABLES.add("kfold_plain", f"WITH {RANKED_LABELS} SELECT doc_id, CAST((rn - 1) % 2 AS INTEGER) AS fold FROM r")
def kfold_plain(spark, sf):
    return sampling.kfold(table(spark, sf, "labels").select("doc_id"), "doc_id", 2)


@TABLES.add(
    "one_class_split",
    """WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5(concat('1|', doc_id))) AS rc,
        count(*) OVER (PARTITION BY toxic) AS nc FROM labels)
      SELECT doc_id, toxic, CASE WHEN toxic = 0 AND rc > ceil(nc * 0.2) THEN 'train' ELSE 'test' END AS split FROM r""",
)
def one_class_split(spark, sf):
    return sampling.one_class_split(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "toxic", benign=0)


# --- evaluation ------------------------------------------------------------------------------------
EMBEDDED = """WITH v AS (SELECT vec_id, unnest(range(1, 33)) AS i, embedding FROM embeddings)
  SELECT vec_id, round(avg({}), 6) AS loss FROM (SELECT vec_id, embedding[i]::DOUBLE AS a, embedding[i + 32]::DOUBLE AS p FROM v) GROUP BY vec_id"""


def _halves(spark, sf):
    rows, names = fx.embeddings(spark, sf)
    return rows, names[:32], names[32:]


@TABLES.add("row_mae", EMBEDDED.format("abs(a - p)"))
def row_mae(spark, sf):
    """One half of each vector against the other."""
    rows, actual, predicted = _halves(spark, sf)
    return rows.select("vec_id", F.round(evaluate.row_mae(actual, predicted), 6).alias("loss"))


@TABLES.add("row_mse", EMBEDDED.format("(a - p) * (a - p)"))
def row_mse(spark, sf):
    rows, actual, predicted = _halves(spark, sf)
    return rows.select("vec_id", F.round(evaluate.row_mse(actual, predicted), 6).alias("loss"))


@TABLES.add(
    "mae_threshold",
    WITH
    + """ SELECT round(abs((SELECT avg((abs(l_discount) + abs(l_tax)) / 2) FROM feature_table WHERE malware_label = 1)
      - (SELECT avg((abs(l_discount) + abs(l_tax)) / 2) FROM feature_table WHERE malware_label = 0)) * 4, 9) AS threshold""",
)
def mae_threshold(spark, sf):
    rows, names = features(spark, sf), ["l_discount", "l_tax"]
    limit = evaluate.mae_threshold(columns.filter_class(rows, 0), columns.filter_class(rows, 1), names, names)
    return rounded(limit, "threshold", 9)


@TABLES.add(
    "error_by_class",
    WITH
    + """ SELECT malware_label, count(*) AS n, round(avg(l_discount), 6) AS mean_loss, min(l_discount) AS min_loss, max(l_discount) AS max_loss,
      count(*) FILTER (WHERE l_discount > 0.055) AS anomalies FROM feature_table GROUP BY malware_label""",
)
def error_by_class(spark, sf):
    return rounded(evaluate.error_by_class(features(spark, sf), "l_discount", 0.055), "mean_loss")


def predictions(spark, sf):
    return features(spark, sf).select(LABEL, "l_discount", (F.col("l_discount") > 0.055).cast("int").alias("prediction"))


PREDICTED = WITH + ", p AS (SELECT malware_label, CAST(l_discount > 0.055 AS INTEGER) AS prediction FROM feature_table)"
COUNTS = """, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE malware_label = prediction) AS ok,
  count(*) FILTER (WHERE malware_label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE prediction = 1) AS said,
  count(*) FILTER (WHERE malware_label = 1) AS truth FROM p)"""


@TABLES.add(
    "confusion_matrix",
    PREDICTED
    + """, g AS (SELECT a.v AS label, b.v AS prediction FROM (VALUES (0), (1)) a(v), (VALUES (0), (1)) b(v))
      SELECT g.label, g.prediction, count(p.prediction) AS n FROM g LEFT JOIN p ON p.malware_label = g.label AND p.prediction = g.prediction
      GROUP BY g.label, g.prediction""",
)
def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(predictions(spark, sf), LABEL, "prediction")


@TABLES.add(
    "classification_scores",
    PREDICTED + COUNTS + " SELECT round(ok / n, 6) AS accuracy, round(tp / said, 6) AS precision, round(tp / truth, 6) AS recall FROM c",
)
def classification_scores(spark, sf):
    scores = evaluate.classification_scores(predictions(spark, sf), LABEL, "prediction").drop("f_beta")
    return rounded(scores, scores.columns)


@TABLES.add(
    "f_beta",
    PREDICTED + COUNTS + " SELECT round(5 * (tp / said) * (tp / truth) / (4 * (tp / said) + tp / truth), 6) AS f_beta FROM c",
)
def f_beta(spark, sf):
    return rounded(evaluate.classification_scores(predictions(spark, sf), LABEL, "prediction").select("f_beta"), "f_beta")


SWEEP = """, k AS (SELECT {score} AS threshold, count(*) FILTER (WHERE malware_label = 1) AS pos,
    count(*) FILTER (WHERE malware_label = 0) AS neg FROM feature_table GROUP BY {score}),
  w AS (SELECT *, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp,
    lead(pos) OVER (ORDER BY threshold DESC) AS next_pos, lead(neg) OVER (ORDER BY threshold DESC) AS next_neg,
    row_number() OVER (ORDER BY threshold DESC) AS place, sum(pos) OVER () AS p, sum(neg) OVER () AS q FROM k)"""
BENDS = " WHERE place = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg"


@TABLES.add(
    "roc_curve",
    WITH + SWEEP.format(score="l_extendedprice") + " SELECT threshold, round(fp / q, 6) AS fpr, round(tp / p, 6) AS tpr FROM w" + BENDS,
)
def roc_curve(spark, sf):
    return rounded(evaluate.roc_curve(features(spark, sf), "l_extendedprice", LABEL), ["fpr", "tpr"])


@TABLES.add(
    "roc_curve_all_points",
    WITH
    + SWEEP.format(score="l_discount")
    + " SELECT threshold, round(fp / q, 6) AS fpr, round(tp / p, 6) AS tpr FROM w UNION ALL SELECT NULL, 0, 0",
)
def roc_curve_all_points(spark, sf):
    points = evaluate.roc_curve(features(spark, sf), "l_discount", LABEL, drop_intermediate=False, origin=True)
    return rounded(points, ["fpr", "tpr"])


@TABLES.add(
    "roc_auc",
    WITH + SWEEP.format(score="l_extendedprice") + " SELECT round(sum(neg * (tp - pos / 2.0)) / (max(p) * max(q)), 6) AS auc FROM w",
)
def roc_auc(spark, sf):
    return rounded(evaluate.roc_auc(features(spark, sf), "l_extendedprice", LABEL), "auc")


@TABLES.add(
    "mean_roc_threshold", WITH + SWEEP.format(score="l_extendedprice") + " SELECT round(avg(threshold), 4) AS threshold FROM w" + BENDS
)
def mean_roc_threshold(spark, sf):
    return evaluate.mean_roc_threshold(features(spark, sf), "l_extendedprice", LABEL)


@TABLES.add(
    "pr_curve",
    WITH
    + SWEEP.format(score="l_extendedprice")
    + " SELECT threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM w WHERE tp - pos < p",
)
def pr_curve(spark, sf):
    return rounded(evaluate.pr_curve(features(spark, sf), "l_extendedprice", LABEL), ["precision", "recall"])
