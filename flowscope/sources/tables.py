"""The feature table on disk: Parquet by preference, CSV with a header, compressed by gzip, for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowscope import schema as S
from flowscope.sources.batches import append_once, read_batches


#: Most cells of a flow are zero, so compressed files are a small part of the text. They can't be split, hence the limit on rows.
FEATURE_CSV = {"header": True, "compression": "gzip", "maxRecordsPerFile": 100_000}


def write_features(features: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """The 519 columns in fixed order. Appending is atomic per job; each CSV file has its own header."""
    ordered = features.select(*S.FEATURE_COLUMNS)
    options = FEATURE_CSV if fmt == "csv" else {}
    ordered.write.mode(mode).options(**options).format(fmt).save(path)


def read_features(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read with the known schema, so there is no pass to infer one."""
    reader = spark.read.schema(S.FEATURE_TABLE)
    return reader.csv(path, header=True, enforceSchema=False) if fmt == "csv" else reader.format(fmt).load(path)


def append_features(features: DataFrame, path: str, batch: str, fmt: str = "parquet") -> bool:
    """Append a batch exactly once, however often its job is run; False if it was there already."""
    options = FEATURE_CSV if fmt == "csv" else {}
    return append_once(features.select(*S.FEATURE_COLUMNS), path, batch, fmt, **options)


def read_feature_batches(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    options = {"header": True, "enforceSchema": False} if fmt == "csv" else {}
    return read_batches(spark, path, S.FEATURE_TABLE, fmt, **options)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    options = {"header": True} if fmt == "csv" else {}
    df.write.mode(mode).options(**options).format(fmt).save(path)


def preview(df: DataFrame, rows: int = 20) -> DataFrame:
    """The rows a terminal would print."""
    return df.limit(rows)
