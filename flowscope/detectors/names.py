"""Generated-name scores from character n-grams with back-off.

Learned from labelled names: for every n-gram up to ``order`` characters the log of its frequency among generated names over
that among others, with ``PRIOR`` counts added. A name is scored by its positions: at each, the longest n-gram that
ends there and was seen ``SEEN`` times or more speaks, or none; the score is the logistic of their sum and the classes' log
odds. All of it is counting, joins and expressions. The name is read up to its first dot, in lower case, with a mark
on either side.

Null and empty names score 0, as in the lookup; repeated names are scored once and counted as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.operators.skew import attach

ORDER, SEEN, PRIOR = 3, 5, 1.0


def marked(name: Column) -> Column:
    return F.concat(F.lit("^"), F.lower(F.substring_index(name, ".", 1)), F.lit("$"))


def grams(names: DataFrame, name: str, order: int) -> DataFrame:
    """The columns of ``names`` with ``at`` and ``gram``: the n-grams that end at each character, n = 1 to ``order``."""
    text = marked(F.col(name))
    ends = names.withColumn("_text", text).withColumn("at", F.explode(F.sequence(F.lit(1), F.length(text))))
    sized = ends.withColumn("_n", F.explode(F.sequence(F.lit(1), F.least(F.lit(order), F.col("at")))))
    gram = F.col("_text").substr(F.col("at") - F.col("_n") + 1, F.col("_n"))
    return sized.withColumn("gram", gram).drop("_text", "_n")


def learn_names(labelled: DataFrame, name: str = "domain", label: str = "label", order: int = ORDER) -> DataFrame:
    """``gram, odds`` of the n-grams seen often enough, and the classes' log odds as the gram of no characters."""
    named = labelled.where(F.coalesce(F.col(name), F.lit("")) != "").select(F.col(name).alias("name"), F.col(label).alias("label"))
    counts = grams(named, "name", order).groupBy("gram").agg(F.sum("label").alias("one"), F.sum(1 - F.col("label")).alias("zero"))
    size = F.length("gram").alias("size")
    sums = counts.groupBy(size).agg(F.sum("one").alias("ones"), F.sum("zero").alias("zeros"), F.count("*").alias("grams"))  # a row for each n
    share = lambda n, total: F.log((F.col(n) + PRIOR) / (F.col(total) + PRIOR * F.col("grams")))
    often = counts.where(F.col("one") + F.col("zero") >= SEEN).withColumn("size", F.length("gram")).join(F.broadcast(sums), "size")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)) + PRIOR
    classes = named.agg(F.log(total(F.col("label")) / total(1 - F.col("label"))).alias("odds"))
    return often.select("gram", (share("one", "ones") - share("zero", "zeros")).alias("odds")).union(classes.select(F.lit("").alias("gram"), "odds"))


def score_names(names: DataFrame, model: DataFrame, name: str = "domain", order: int = ORDER) -> DataFrame:
    """``domain, prob`` for every distinct name, a table as the score lookup takes it."""
    distinct = names.select(F.col(name).alias("domain")).where(F.coalesce(F.col(name), F.lit("")) != "").distinct()
    found = attach(grams(distinct, "domain", order), model.where("gram <> ''"), ["gram"], ["domain", "at"])
    longest = found.where("odds is not null").groupBy("domain", "at").agg(F.max_by("odds", F.length("gram")).alias("odds"))
    sums = longest.groupBy("domain").agg(F.sum("odds").alias("odds"))
    bias = model.where("gram = ''").agg(F.first("odds")).scalar()
    total = F.coalesce(F.col("odds"), F.lit(0.0)) + bias
    return distinct.join(sums, "domain", "left").select("domain", (1 / (1 + F.exp(-total))).alias("prob"))
