"""Quality rules with DataFrame operations only: counts of each text, and a hashed n-gram likelihood ratio.

Words and pairs of neighbouring words are hashed into ``BUCKETS`` buckets. One multinomial over the buckets is counted
from trusted documents, one from all documents. A bucket's log ratio is taken only as far as it goes beyond ``ERRORS``
standard errors and a factor of ``FACTOR``, else it is 0: what few counts or a few families of copies make is left out, so
the few words that trusted documents avoid aren't lost among hundreds of others. A document's score is the sum of its
n-grams' log ratios (trusted over raw) divided by their number, and a document is kept if its score is at least the
threshold. Without a given threshold it is the score that a share ``LOST`` of the trusted documents of ten words or more
lies below, found exactly in steps of ``1 / STEPS`` from all of them. The table of log ratios has ``BUCKETS`` numbers at
any input size. Scores are sums in text order, so equal texts always get equal verdicts.

Defined results: null, empty and blank texts have no words and fail the base rules; repeated rows are counted as often
as they occur; without trusted documents every score and the threshold are 0; a trusted id that is null or unknown counts
nothing; documents with a null id are scored but never trusted; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.llm.common import let, words
from flowscope.operators.skew import BROADCAST_ROWS
from flowscope.session import materialized

BUCKETS = 1 << 18
#: Counts added to each bucket, on the trusted corpus's scale.
SMOOTHING = 1.0
ERRORS = 2.0
FACTOR = 2.0
#: Share of the trusted documents that the threshold may reject.
LOST = 0.01
STEPS = 10_000
SHORTEST = 10
WINDOW = 5
SYMBOLS = "[#*$%&|<>]"


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def buckets(hashes: Column) -> Column:
    """Buckets of all words, then of all pairs of neighbours."""

    def both(h: Column) -> Column:
        single = F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))
        after = F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0)))
        before = F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0)))
        pairs = F.zip_with(before, after, lambda x, y: F.pmod(F.xxhash64(x, y), F.lit(BUCKETS)).cast("int"))
        return F.concat(single, pairs)

    return let(hashes, both)


def trusted_ids(trusted: DataFrame, ident: str) -> DataFrame:
    """The distinct ids as ``id``; up to BROADCAST_ROWS of them are broadcast, beyond that a join with them shuffles."""
    ids = trusted.select(F.col(ident).alias("id")).where("id is not null").distinct()
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def log_ratios(docs: DataFrame, ids: DataFrame, text: str = "text", ident: str = "doc_id") -> Column:
    """Scalar ``array<double>``: the log ratio of each bucket, trusted over raw. It is written once, as one row."""
    ids = ids.withColumn("trusted", F.lit(1))
    grams = docs.select(F.col(ident).alias("id"), buckets(word_hashes(F.col(text))).alias("grams")).join(ids, "id", "left")
    # with the outer form no filter on the array's size is added, which would compute the array twice
    seen = grams.select(F.explode_outer("grams").alias("bucket"), F.coalesce("trusted", F.lit(0)).alias("trusted"))
    counts = seen.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    rows = F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))))
    whole = every.agg(rows.alias("rows"), F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("target"))

    def ratio(x: Column) -> Column:
        seen, expected = x["target"] + SMOOTHING, x["raw"] * (F.col("target") / F.col("raw")) + SMOOTHING
        sure = F.abs(F.log(seen / expected)) - ERRORS * F.sqrt(1 / seen + 1 / expected) - math.log(FACTOR)
        return F.when((F.col("target") == 0) | (sure <= 0), F.lit(0.0)).otherwise(F.signum(seen - expected) * sure)

    return materialized(whole.select(F.transform("rows", ratio).alias("ratios")), "ratios").scalar()


def trusted_threshold(scored: DataFrame, ids: DataFrame, lost: float) -> float:
    """The score that a share ``lost`` of the trusted documents lies below, rounded down to a step; 0 without any."""
    step = F.when(F.col("n_words") >= SHORTEST, F.floor(F.col("score") * STEPS))
    # counted by distinct step, so it is exact, the same in any order, and its size doesn't grow with the rows
    found = scored.select("id", step.alias("step")).join(ids, "id", "left_semi").agg(F.percentile("step", lost)).first()[0]
    return 0.0 if found is None else math.floor(found) / STEPS


def mean_ratio(hashes: Column, ratios: Column) -> Column:
    """Log ratio per n-gram; 0 without words."""

    def mean(found: Column) -> Column:
        total = F.aggregate(found, F.lit(0.0), lambda sum_, b: sum_ + F.get(ratios, b))
        return F.when(F.size(found) == 0, F.lit(0.0)).otherwise(total / F.size(found))

    return let(buckets(hashes), mean)


def repeated_words(hashes: Column) -> Column:
    """Number of words in windows of five whose words occur, in the same order, twice or more in the text."""

    def by_hash(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)]))

    def covered(windows: Column) -> Column:
        def repeats(ordered: Column) -> Column:
            # in the order of (hash, place), places whose neighbour has the same hash
            like = lambda x, i: F.coalesce(F.get(ordered, i)["hash"] == x["hash"], F.lit(False))
            return F.sort_array(F.transform(F.filter(ordered, lambda x, i: like(x, i - 1) | like(x, i + 1)), lambda x: x["place"]))

        def count(starts: Column) -> Column:
            begin = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(
                starts,
                begin,
                lambda at, i: F.struct(i.alias("last"), (at["n"] + F.least(F.lit(WINDOW), i - at["last"])).alias("n")),
                lambda at: at["n"],
            )

        placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("hash"), i.alias("place"))))
        unlike = F.size(F.array_distinct(windows)) == F.size(windows)
        return F.when(unlike, F.lit(0)).otherwise(let(let(placed, repeats), count))

    return let(hashes, lambda h: F.when(F.size(h) < WINDOW + 1, F.lit(0)).otherwise(let(by_hash(h), covered)))


def rule_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the array of word hashes."""
    own = F.coalesce(F.col(text), F.lit(""))
    found = words(F.col(text))
    lines = F.filter(F.split(own, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    repeats = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    measured = let(
        found,
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            F.transform(w, lambda x: F.xxhash64(x)).alias("hashes"),
        ),
    )
    out = docs.withColumns({
        "_measured": measured,
        "n_symbols": F.regexp_count(own, F.lit(SYMBOLS)).cast("bigint"),
        "n_dup_lines": repeats.cast("bigint"),
    })
    return out.select(
        *[c for c in out.columns if c != "_measured"], "_measured.*", repeated_words(F.col("_measured.hashes")).cast("bigint").alias("n_repeat_words")
    )


def quality(
    docs: DataFrame, trusted: DataFrame, threshold: float | None = None, lost: float = LOST, text: str = "text", ident: str = "doc_id"
) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) of each document;
    ``trusted`` has the trusted ids in a column named like ``ident``."""
    narrow = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    ids = trusted_ids(trusted, ident)
    ratios = log_ratios(docs, ids, text, ident)
    counted = rule_counts(narrow).withColumn("_ratios", ratios)
    counted = counted.withColumn("score", mean_ratio(F.col("hashes"), F.col("_ratios"))).drop("hashes", "text", "_ratios")
    if threshold is None:
        # some numbers a document, written so that texts are scored once
        counted = materialized(counted, "scores")
        threshold = trusted_threshold(counted, ids, lost)
    failed = (F.col("n_words") < SHORTEST) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "score", (~failed & (F.col("score") >= threshold)).alias("kept"),
    )
