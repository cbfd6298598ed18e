"""Dates and timestamps. Nothing here reads the clock: "now" is always an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: timestamp formats of the intelligence sources -----------------------------------
OTX_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
URLHAUS_FORMAT = "yyyy-MM-dd HH:mm:ss 'UTC'"
BLACKLIST_FORMAT = "yyyy-MM-dd HH:mm:ss"
BLACKLIST_SWAPPED_FORMAT = "yyyy-dd-MM HH:mm:ss"
# --- end of fixed values ---------------------------------------------------------------------------


def parse_ts(text: Column, fmt: str) -> Column:
    """Timestamp, null where the text does not match."""
    return F.try_to_timestamp(text, F.lit(fmt))


def age_days(start: Column, end: Column) -> Column:
    """Whole days from start to end, truncated toward zero."""
    return ((F.unix_timestamp(end) - F.unix_timestamp(start)) / 86400).cast("bigint")


def date_range(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """One row per day, both ends included."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(days).alias("day"))


def days_between(start: Column, end: Column) -> Column:
    """Array of the days from start to end, both included; empty where end is before start."""
    days = F.sequence(start.cast("date"), end.cast("date"), F.expr("interval 1 day"))
    return F.when(end.cast("date") >= start.cast("date"), days).otherwise(F.array().cast("array<date>"))
