"""Training-data pipeline over ``documents``: each stage is written as Parquet and reread by the next.

All stages but the last return the columns of documents. A document leaves the pipeline if its language isn't found
with the margin, if it is a near copy of one with a smaller id, or if it overlaps a benchmark item.

SQL can't express compression sizes, densified hashing or the tokenizer, so there is no twin of the whole; the tests
compare each stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.llm.bpe import Vocabulary, encode
from flowscope.llm.common import table, unused
from flowscope.llm.decontaminate import decontaminated
from flowscope.llm.language import dictionaries, keep_identified
from flowscope.llm.neardup import deduplicated
from flowscope.llm.pii import pseudonymised
from flowscope.llm.queries import LANGUAGE_MARGIN, PII_KEY, vocabulary_path
from flowscope.session import materialized


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified, by dictionaries from their own labelled rows."""
    return keep_identified(docs, dictionaries(docs), LANGUAGE_MARGIN)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 of their five-word shingles."""
    return deduplicated(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data; n_chars follows a changed text."""
    name = unused(docs, "_fresh")
    fresh = docs.withColumn(name, pseudonymised(F.col("text"), PII_KEY))
    same = F.col(name).eqNullSafe(F.col("text"))
    columns = {"text": F.col(name), "n_chars": F.when(same, F.col("n_chars")).otherwise(F.length(name).cast("bigint"))}
    return fresh.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns])


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of the ids and of their decoded text."""
    return encode(docs, Vocabulary(vocabulary_path()))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("encoding", encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir), name)
    return docs
