"""Seeded exact-size samples, splits and folds by hash order.

Rows are ordered by ``md5(seed|id)``, which is stable across partitionings and retries. Rows that repeat an id share a
hash; among them the place in the table decides, so sizes are exact for them too, while which of them are taken may change
with the partitioning. Give a written table where ids repeat: its places are the same in every scan. All rows of one id are
ranked in one task, so ids should not be shared by a large part of the table.
An exact sample is the filter ``(hash, place) <= cut``. The cut is found with counts per hash prefix and a look into
the one prefix where the wanted size is reached, so there is no global sort, no limit and no shuffle of
whole rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX = 4  # hex digits: 65,536 hash ranges
PLACE = "_place_of_row"
BENIGN, MALWARE = 0, 1


def row_hash(row_id: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string")))


def placed(df: DataFrame) -> DataFrame:
    """Add the place of each row, which ``hash_cuts`` and ``within`` need."""
    return df.withColumn(PLACE, F.monotonically_increasing_id())


def hash_cuts(
    df: DataFrame, row_id: str, seed: int, quota: Callable[[DataFrame], DataFrame], by: Column | None = None
) -> Column:
    """Scalar map class -> largest (hash, place) in the sample, of a ``placed`` table.

    ``quota`` turns ``(class, n)``, one row per class, into ``(class, want)``. Classes are few by nature, so
    the map is small. A class that wants nothing is absent; one that wants more than it has is taken whole.
    """
    cls = F.lit("all") if by is None else by.cast("string")
    hashed = df.select(cls.alias("class"), row_hash(row_id, seed).alias("h"), F.col(PLACE).alias("t"))
    hashed = hashed.withColumn("prefix", F.substring("h", 1, PREFIX))
    histogram = hashed.groupBy("class", "prefix").agg(F.count("*").alias("n"))
    sizes = histogram.groupBy("class").agg(F.sum("n").alias("n"))
    wanted = quota(sizes).select("class", "want").join(sizes, "class").select("class", F.least("want", "n").alias("want"))

    upto = Window.partitionBy("class").orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = (
        histogram.withColumn("upto", F.sum("n").over(upto))
        .join(F.broadcast(wanted), "class")
        .where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want")))
        .select("class", "prefix", (F.col("want") - F.col("upto") + F.col("n")).alias("need"))
    )
    place = F.row_number().over(Window.partitionBy("class").orderBy("h", "t"))
    cuts = (
        hashed.join(F.broadcast(edges), ["class", "prefix"])
        .withColumn("place", place)
        .where(F.col("place") == F.col("need"))
        .select(F.struct("class", F.struct("h", "t")).alias("cut"))
    )
    return cuts.agg(F.map_from_entries(F.collect_list("cut")).alias("cuts")).scalar()


def within(cuts: Column, row_id: str, seed: int, by: Column | None = None) -> Column:
    """Whether a row of a ``placed`` table is in the sample."""
    cls = F.lit("all") if by is None else by.cast("string")
    own = F.struct(row_hash(row_id, seed).alias("h"), F.col(PLACE).alias("t"))
    return F.coalesce(own <= F.try_element_at(cuts, cls), F.lit(False))


def fixed_quota(want: int) -> Callable[[DataFrame], DataFrame]:
    return lambda sizes: sizes.select("class", F.lit(want).cast("bigint").alias("want"))


def sample_n(df: DataFrame, row_id: str, n: int, seed: int = 42, by: str | None = None) -> DataFrame:
    """Exactly n rows (all, if there are fewer); with ``by``, n rows of each class."""
    cls, df = None if by is None else F.col(by), placed(df)
    return df.where(within(hash_cuts(df, row_id, seed, fixed_quota(n), cls), row_id, seed, cls)).drop(PLACE)


def class_ratio_sample(
    df: DataFrame,
    row_id: str,
    label: str,
    size: int,
    malware_percent: float = 20.0,
    test_percent: float | None = None,
    benign: int = BENIGN,
    malware: int = MALWARE,
    seed: int = 42,
) -> DataFrame:
    """``size`` rows with a given malware share, each class capped at what there is.

    Malware is ``int(m% * size)``, or ``int(m% * int(t% * size))`` when ``test_percent`` is given (the
    one-class form); the benign class fills up to ``size``.
    """
    share = F.lit(float(malware_percent)) / 100.0
    base = F.lit(size)
    if test_percent is not None:
        base = ((F.lit(float(test_percent)) / 100.0) * F.lit(size)).cast("bigint")

    def quota(sizes: DataFrame) -> DataFrame:
        is_malware = F.col("class") == str(malware)
        available = F.coalesce(F.sum(F.when(is_malware, F.col("n"))).over(Window.partitionBy()), F.lit(0))
        taken = F.least((share * base).cast("bigint"), available)
        return sizes.select("class", F.when(is_malware, taken).otherwise(F.lit(size) - taken).alias("want"))

    rows = placed(df.where(F.col(label).isin(benign, malware)))
    cls = F.col(label)
    return rows.where(within(hash_cuts(rows, row_id, seed, quota, cls), row_id, seed, cls)).drop(PLACE)


def shuffled(df: DataFrame, row_id: str, seed: int = 42) -> DataFrame:
    """Rows in hash order, for callers that consume an order."""
    return df.orderBy(row_hash(row_id, seed))


def downsample_class(
    df: DataFrame, row_id: str, label: str, percent: float, value: int = BENIGN, seed: int = 42
) -> DataFrame:
    """Keep ``int(count * percent/100)`` rows of one class and all of the others."""
    df = placed(df)
    part = df.where(F.col(label) == value)
    quota = lambda sizes: sizes.select("class", (F.col("n") * F.lit(percent / 100.0)).cast("bigint").alias("want"))
    kept = within(hash_cuts(part, row_id, seed, quota), row_id, seed)
    return df.where((F.col(label) != value) | kept).drop(PLACE)


def train_test_split(
    df: DataFrame, row_id: str, test_fraction: float = 0.2, seed: int = 42, name: str = "split"
) -> DataFrame:
    """Add ``split``: ``ceil(fraction * n)`` rows are ``test``, the complement is ``train``."""
    df = placed(df)
    quota = lambda sizes: sizes.select("class", F.ceil(F.col("n") * F.lit(test_fraction)).alias("want"))
    test = within(hash_cuts(df, row_id, seed, quota), row_id, seed)
    return df.withColumn(name, F.when(test, "test").otherwise("train")).drop(PLACE)


def hash_split(
    df: DataFrame, row_id: str, test_fraction: float = 0.2, seed: int = 42, name: str = "split"
) -> DataFrame:
    """The same in one pass with an approximate size: a threshold on the hash."""
    limit = f"{min(int(test_fraction * 16**8), 16**8 - 1):08x}"
    return df.withColumn(name, F.when(row_hash(row_id, seed) < limit, "test").otherwise("train"))


def three_way_split(df: DataFrame, row_id: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """``test`` is ``ceil(f*n)`` rows, ``valid`` ``ceil(f*rest)`` of the rest (0.64 / 0.16 / 0.20 by default)."""
    test_size = F.ceil(F.col("n") * F.lit(fraction))
    valid_size = F.ceil((F.col("n") - test_size) * F.lit(fraction))
    df = placed(df)
    test = hash_cuts(df, row_id, seed, lambda s: s.select("class", test_size.alias("want")))
    held = hash_cuts(df, row_id, seed, lambda s: s.select("class", (test_size + valid_size).alias("want")))
    split = F.when(within(test, row_id, seed), "test").when(within(held, row_id, seed), "valid").otherwise("train")
    return df.withColumn("split", split).drop(PLACE)


def hash_rank(df: DataFrame, row_id: str, seed: int = 42, by: str | None = None, name: str = "rank") -> DataFrame:
    """Add the dense 0-based rank by hash order, within each class if ``by`` is given.

    Ranks are taken per hash prefix and shifted by the sizes of the prefixes before it: at most 65,536 shift
    rows per class, and no task ranks more than a prefix.
    """
    keys = ([by] if by else []) + ["_prefix"]
    hashed = placed(df).withColumn("_h", row_hash(row_id, seed)).withColumn("_prefix", F.substring("_h", 1, PREFIX))
    before = Window.partitionBy(*keys[:-1]).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    sizes = hashed.groupBy(*keys).agg(F.count("*").alias("_n"))
    shifts = sizes.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", PLACE))
    return (
        hashed.withColumn("_rank", number)
        .join(F.broadcast(shifts), keys)
        .withColumn(name, (F.col("_rank") - 1 + F.col("_shift")).cast("bigint"))
        .drop("_h", "_prefix", "_rank", "_shift", PLACE)
    )


def kfold(df: DataFrame, row_id: str, k: int, seed: int = 42, by: str | None = None, name: str = "fold") -> DataFrame:
    """Fold ``rank mod k`` by hash order, within each class if ``by`` is given (stratified)."""
    return hash_rank(df, row_id, seed, by, "_place").withColumn(name, (F.col("_place") % k).cast("int")).drop("_place")


def one_class_split(
    df: DataFrame, row_id: str, label: str, benign: int = 1, test_fraction: float = 0.2, seed: int = 1
) -> DataFrame:
    """Benign rows split into train and test; every malware row is test."""
    df = placed(df)
    normal = df.where(F.col(label) == benign)
    quota = lambda sizes: sizes.select("class", F.ceil(F.col("n") * F.lit(test_fraction)).alias("want"))
    held = within(hash_cuts(normal, row_id, seed, quota), row_id, seed)
    return df.withColumn("split", F.when((F.col(label) == benign) & ~held, "train").otherwise("test")).drop(PLACE)


def union_rows(*parts: DataFrame) -> DataFrame:
    """Bag union by column name; a column a part lacks is null there."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole
