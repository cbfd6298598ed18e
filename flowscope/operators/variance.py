"""Equal-variance tests per feature across classes."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from flowscope.functions.significance import chi2_sf, f_sf
from flowscope.operators.summary import summarize
from flowscope.schema import LABEL

ALPHA = 0.05
ACCURACY = 10_000
PIECES = 256


@F.pandas_udf(DoubleType())
def _chi2_p(statistic: pd.Series, groups: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(t) else chi2_sf(t, int(k) - 1) for t, k in zip(statistic, groups)], dtype=float)


@F.pandas_udf(DoubleType())
def _f_p(statistic: pd.Series, groups: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(w) else f_sf(w, k - 1, total - k) for w, k, total in zip(statistic, groups, n)], dtype=float
    )


def bartlett(df: DataFrame, features: Sequence[str], label: str = LABEL) -> DataFrame:
    """``feature, t, p, equal_var``; no statistic where a class has no spread."""
    stats = summarize(df, features, [label]).withColumn("dof", F.col("n") - 1)
    usable = F.min((F.col("dof") > 0) & (F.coalesce("variance", F.lit(0.0)) > 0))
    sums = stats.groupBy("feature").agg(
        F.count("*").alias("k"),
        F.sum("dof").alias("dof"),
        F.sum(F.col("dof") * F.col("variance")).alias("ss"),
        F.sum(F.col("dof") * F.ln(F.nullif("variance", F.lit(0.0)))).alias("logs"),
        F.sum(F.try_divide(F.lit(1.0), "dof")).alias("inverse"),
        usable.alias("usable"),
    )
    pooled = F.col("dof") * F.ln(F.col("ss") / F.col("dof")) - F.col("logs")
    correction = 1 + (F.col("inverse") - 1 / F.col("dof")) / (3 * (F.col("k") - 1))
    t = F.when(F.col("usable") & (F.col("k") > 1), pooled / correction)
    out = sums.select("feature", "k", t.alias("t")).withColumn("p", _chi2_p("t", "k"))
    return out.select("feature", "t", "p", (F.col("p") > ALPHA).alias("equal_var"))


def unpivot_features(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features]
    return df.select(*keep, F.explode(F.array(*cells)).alias("cell")).select(*keep, "cell.feature", "cell.value")


def exact_median(long: DataFrame, groups: Sequence[str], value: str = "value") -> DataFrame:
    """Median per group without gathering a group.

    A sketch brackets the middle ranks. Values outside the bracket are only counted; inside, they are combined
    per distinct value and cut into equal-width pieces. Piece totals tell which one or two pieces hold the
    middle ranks, and only their values are walked in order.
    """
    groups = list(groups)
    margin = 3 / ACCURACY
    limits = F.percentile_approx(value, F.array(F.lit(0.5 - margin), F.lit(0.5 + margin)), ACCURACY)
    band = long.groupBy(*groups).agg(limits.alias("band"))
    # one row per class and feature
    placed = long.join(F.broadcast(band), groups)
    low, high, x = F.col("band")[0], F.col("band")[1], F.col(value)
    inner = F.coalesce(F.width_bucket(x, low, high, F.lit(PIECES)), F.lit(0)).cast("int")
    piece = F.when(x < low, -1).when(x > high, PIECES + 2).otherwise(inner)
    inside = x.between(low, high)
    counted = (
        placed.select(*groups, piece.alias("_piece"), F.when(inside, x).alias("_x"))
        .groupBy(*groups, "_piece", "_x")
        .agg(F.count("*").alias("_n"))
    )
    # at most PIECES + 3 rows per group
    totals = counted.groupBy(*groups, "_piece").agg(F.sum("_n").alias("_m"))
    upto = Window.partitionBy(*groups).orderBy("_piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = totals.withColumns(
        {"_end": F.sum("_m").over(upto), "_total": F.sum("_m").over(Window.partitionBy(*groups))}
    ).withColumns(
        {"_low": F.floor((F.col("_total") + 1) / 2), "_high": F.floor((F.col("_total") + 2) / 2), "_start": F.col("_end") - F.col("_m")}
    )
    middle = ranked.where((F.col("_start") < F.col("_high")) & (F.col("_end") >= F.col("_low")))
    middle = middle.select(*groups, "_piece", "_start", "_low", "_high")
    walk = Window.partitionBy(*groups, "_piece").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = counted.join(F.broadcast(middle), [*groups, "_piece"]).withColumn(
        "_upto", F.col("_start") + F.sum("_n").over(walk)
    )
    holds = lambda rank: (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank)
    at = lambda rank: F.max(F.when(holds(F.col(rank)), F.col("_x")))
    return walked.groupBy(*groups).agg(((at("_low") + at("_high")) / 2).alias("median"))


def levene(df: DataFrame, features: Sequence[str], label: str = LABEL) -> DataFrame:
    """Median-centred form: one-way analysis of variance of ``|x - median|``. ``feature, w, p, equal_var``."""
    long = unpivot_features(df, features, [label])
    medians = exact_median(long, [label, "feature"])
    z = F.abs(F.col("value") - F.col("median"))
    spread = long.join(F.broadcast(medians), [label, "feature"]).select(label, "feature", z.alias("z"))
    classes = spread.groupBy(label, "feature").agg(
        F.count("*").alias("n"), F.avg("z").alias("mean"), F.var_pop("z").alias("variance")
    )
    sums = classes.groupBy("feature").agg(
        F.count("*").alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("variance")).alias("inside"),
        F.sum(F.col("n") * F.col("mean")).alias("total"),
        F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("squares"),
    )
    between = F.col("squares") - F.col("total") * F.col("total") / F.col("n")
    w = F.try_divide((F.col("n") - F.col("k")) * between, (F.col("k") - 1) * F.col("inside"))
    out = sums.select("feature", "k", "n", w.alias("w")).withColumn("p", _f_p("w", "k", "n"))
    return out.select("feature", "w", "p", (F.col("p") > ALPHA).alias("equal_var"))


def factor_analysis(df: DataFrame, features: Sequence[str], label: str = LABEL, eq_var: bool = True) -> DataFrame:
    """Features whose Bartlett verdict, or failing that the Levene verdict, is ``eq_var``, with both tests."""
    tests = bartlett(df, features, label).select("feature", "t", F.col("p").alias("p_bartlett"), F.col("equal_var").alias("b"))
    other = levene(df, features, label).select("feature", "w", F.col("p").alias("p_levene"), F.col("equal_var").alias("l"))
    both = tests.join(other, "feature")
    chosen = F.when(F.col("b") == eq_var, "bartlett").when(F.col("l") == eq_var, "levene")
    return both.withColumn("test", chosen).where("test is not null").drop("b", "l")
