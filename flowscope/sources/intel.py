"""Threat-intelligence snapshots."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope import schema as S
from flowscope.functions.documents import path_value


def read_blacklist(spark: SparkSession, path: str) -> DataFrame:
    """Fingerprint blacklist: CSV without a header, comment lines start with ``#``."""
    return spark.read.csv(path, schema=S.BLACKLIST, comment="#")


def read_otx_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=S.OTX_REPORT)


def read_urlhaus_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=S.URLHAUS_REPORT)


def parse_otx_report(general: Column, passive_dns: Column) -> list[Column]:
    """The two documents of an address report held as JSON text."""
    return [
        F.from_json(general, S.OTX_GENERAL).alias("general"),
        F.from_json(passive_dns, S.OTX_DNS).alias("passive_dns"),
    ]


def report_value(df: DataFrame, path: list[str]) -> Column:
    """Nested lookup by names from a column of ``df``, stepping through the first element of lists."""
    head, *rest = path
    return path_value(F.col(head), df.schema[head].dataType, rest)


def read_popularity(
    spark: SparkSession, path: str, first: dt.date | None = None, last: dt.date | None = None, top: int | None = None
) -> DataFrame:
    """Daily ranked domain lists, Parquet partitioned by ``list_date``; the date bounds prune partitions."""
    lists = spark.read.schema(S.POPULARITY).parquet(path)
    if first is not None:
        lists = lists.where(F.col("list_date") >= F.lit(first))
    if last is not None:
        lists = lists.where(F.col("list_date") <= F.lit(last))
    return lists if top is None else lists.where(F.col("rank") <= top)


def write_popularity(lists: DataFrame, path: str) -> None:
    lists.write.mode("append").partitionBy("list_date").parquet(path)


def write_popularity_table(lists: DataFrame, name: str, path: str, buckets: int = 64) -> None:
    """The lists as an external table, partitioned by date and bucketed by domain: lookups by domain need no exchange of the
    lists, a window of dates reads only its partitions. One exchange per write makes one file per date and bucket."""
    dealt = lists.select("list_date", "rank", "domain").repartition(buckets, "domain")
    writer = dealt.write.mode("append").partitionBy("list_date").bucketBy(buckets, "domain").sortBy("domain")
    writer.option("path", path).format("parquet").saveAsTable(name)


def read_popularity_table(spark: SparkSession, name: str, first: dt.date, last: dt.date, top: int) -> DataFrame:
    lists = spark.table(name).select("list_date", "rank", "domain")
    return lists.where(F.col("list_date").between(F.lit(first), F.lit(last)) & (F.col("rank") <= top))
