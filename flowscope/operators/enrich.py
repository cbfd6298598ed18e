"""Threat-intelligence lookups against bulk snapshots instead of per-row requests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.functions import temporal
from flowscope.functions.net import is_ipv4, is_private_ip
from flowscope.operators.skew import attach, distinct_estimate

POPULARITY_DAYS = 15
SETTLE_DAYS = 2  # the newest lists are not out yet, so the window stops two days before as_of
TOP_DOMAINS = 1_000_000


def one_per_key(snapshot: DataFrame, key: str, order: Column, columns: list[Column]) -> DataFrame:
    """First report per key, narrowed to the given columns before the combine."""
    narrow = snapshot.select(F.col(key), order.alias("_order"), F.struct(*columns).alias("_row"))
    return narrow.groupBy(key).agg(F.min_by("_row", "_order").alias("_row")).select(key, "_row.*")


# --- fingerprint blacklist -------------------------------------------------------------------------
def ja3_table(blacklist: DataFrame, swapped_dates: bool = False) -> DataFrame:
    """``Ja3, ja3_urlhaus_status, ja3_urlhaus_age`` with one row per fingerprint (its first entry).

    ``swapped_dates`` reads the dates as year-day-month; entries that do not parse that way are left out.
    """
    fmt = temporal.BLACKLIST_SWAPPED_FORMAT if swapped_dates else temporal.BLACKLIST_FORMAT
    age = temporal.age_days(temporal.parse_ts(F.col("first_seen"), fmt), temporal.parse_ts(F.col("last_seen"), fmt))
    order = F.struct("first_seen", "last_seen")
    table = one_per_key(
        blacklist.withColumnRenamed("ja3", "Ja3"),
        "Ja3",
        order,
        [F.lit(1.0).alias("ja3_urlhaus_status"), age.cast("double").alias("ja3_urlhaus_age")],
    )
    return table.where("ja3_urlhaus_age is not null") if swapped_dates else table


def ja3_lookup(
    flows: DataFrame,
    blacklist: DataFrame,
    spread: str = "flow_id",
    swapped_dates: bool = False,
    hot_source: DataFrame | None = None,
) -> DataFrame:
    """A listed fingerprint gives status 1 and the age of its entry, any other 0 and 0."""
    table = ja3_table(blacklist, swapped_dates)
    joined = attach(flows, table, ["Ja3"], [spread], rows=blacklist.count(), hot_source=hot_source)
    return joined.fillna(0.0, ["ja3_urlhaus_status", "ja3_urlhaus_age"])


# --- address reports -------------------------------------------------------------------------------
def otx_table(reports: DataFrame, order: str) -> DataFrame:
    """``DstIP, otx_status, otx_age``: any pulse gives status 1; the age spans the oldest to newest DNS entry."""
    pulses = F.col("general.pulse_info.pulses")
    records = F.col("passive_dns.passive_dns")
    oldest = temporal.parse_ts(F.try_element_at(records, F.lit(-1))["first"], temporal.OTX_FORMAT)
    newest = temporal.parse_ts(F.try_element_at(records, F.lit(1))["last"], temporal.OTX_FORMAT)
    listed = F.coalesce(F.size(pulses) > 0, F.lit(False))
    age = F.when(listed, F.coalesce(temporal.age_days(oldest, newest), F.lit(0))).otherwise(0)
    return one_per_key(
        reports.withColumnRenamed("ip", "DstIP"),
        "DstIP",
        F.col(order),
        [listed.cast("double").alias("otx_status"), age.cast("double").alias("otx_age")],
    )


def otx_lookup(
    flows: DataFrame, reports: DataFrame, order: str, spread: str = "flow_id", hot_source: DataFrame | None = None
) -> DataFrame:
    joined = attach(flows, otx_table(reports, order), ["DstIP"], [spread], reports.count(), hot_source)
    private = is_private_ip(F.col("DstIP"))
    return joined.withColumns(
        {c: F.when(private, 0.0).otherwise(F.coalesce(c, F.lit(0.0))) for c in ("otx_status", "otx_age")}
    )


# --- host reports ----------------------------------------------------------------------------------
def urlhaus_table(reports: DataFrame, order: str, as_of: dt.datetime) -> DataFrame:
    """``host, verdict{found, status, age}`` from the host reports."""
    found = F.coalesce(F.col("query_status") != "no_results", F.lit(False))
    online = F.try_element_at(F.col("urls"), F.lit(1))["url_status"] == "online"
    seen = temporal.parse_ts(F.col("firstseen"), temporal.URLHAUS_FORMAT)
    status = F.when(~found, 0.0).when(F.coalesce(online, F.lit(False)), 1.0).otherwise(0.5)
    age = F.when(status == 1.0, F.coalesce(temporal.age_days(seen, F.lit(as_of)), F.lit(0))).otherwise(0)
    verdict = F.struct(found.alias("found"), status.alias("status"), age.cast("double").alias("age"))
    return one_per_key(reports, "host", F.col(order), [verdict.alias("verdict")])


def urlhaus_lookup(
    flows: DataFrame,
    reports: DataFrame,
    order: str,
    as_of: dt.datetime,
    spread: str = "flow_id",
    address_fallback: bool = True,
    hot_source: DataFrame | None = None,
) -> DataFrame:
    """Host report by server name, then by address unless that is private (``address_fallback``)."""
    table = urlhaus_table(reports, order, as_of)
    by_name = table.select(F.col("host").alias("SNI"), F.col("verdict").alias("_by_name"))
    verdict = F.when(F.col("_by_name.found"), F.col("_by_name"))
    rows = reports.count()
    joined = attach(flows, by_name, ["SNI"], [spread], rows, hot_source)
    if address_fallback:
        by_address = table.select(F.col("host").alias("DstIP"), F.col("verdict").alias("_by_address"))
        joined = attach(joined, by_address, ["DstIP"], [spread], rows, hot_source)
        closed = is_ipv4(F.col("DstIP")) & is_private_ip(F.col("DstIP"))
        verdict = F.coalesce(verdict, F.when(~closed, F.col("_by_address")))
    return joined.withColumns(
        {
            "urlhaus_status": F.coalesce(verdict["status"], F.lit(0.0)),
            "urlhaus_age": F.coalesce(verdict["age"], F.lit(0.0)),
        }
    ).drop("_by_name", "_by_address")


# --- domain popularity -----------------------------------------------------------------------------
def popularity_table(
    wanted: DataFrame, lists: DataFrame, as_of: dt.date, days: int = POPULARITY_DAYS, top: int = TOP_DOMAINS
) -> DataFrame:
    """``SNI, dom_in_tranco_1m`` for the wanted names that are listed at all.

    The date filter prunes the list partitions and the semi-join drops unwanted names before grouping. The
    window holds ``days - 1`` lists and the count is divided by ``days``, so the score never reaches 1.
    """
    first, last = as_of - dt.timedelta(days), as_of - dt.timedelta(SETTLE_DAYS)
    recent = lists.where(F.col("list_date").between(first, last) & (F.col("rank") <= top))
    names = recent.select("list_date", F.col("domain").alias("SNI"))
    listed = names.join(wanted.where("SNI != ''").select("SNI").distinct(), "SNI", "left_semi").distinct()
    return listed.groupBy("SNI").agg((F.count("*") / F.lit(days)).alias("dom_in_tranco_1m"))


def domain_popularity(
    flows: DataFrame,
    lists: DataFrame,
    as_of: dt.date,
    days: int = POPULARITY_DAYS,
    top: int = TOP_DOMAINS,
    spread: str = "flow_id",
    wanted: DataFrame | None = None,
) -> DataFrame:
    source = flows if wanted is None else wanted
    table = popularity_table(source, lists, as_of, days, top)
    rows = distinct_estimate(source, ["SNI"])
    return attach(flows, table, ["SNI"], [spread], rows, source).fillna(0.0, ["dom_in_tranco_1m"])


# --- generated-domain score ------------------------------------------------------------------------
def dga_score(
    flows: DataFrame, scores: DataFrame, spread: str = "flow_id", hot_source: DataFrame | None = None
) -> DataFrame:
    """Score table ``domain, prob`` joined by server name; no name or no score gives 0."""
    table = scores.groupBy(F.col("domain").alias("SNI")).agg(F.max("prob").alias("dom_dga_prob"))
    joined = attach(flows, table, ["SNI"], [spread], rows=scores.count(), hot_source=hot_source)
    score = F.when(F.coalesce("SNI", F.lit("")) != "", F.coalesce("dom_dga_prob", F.lit(0.0))).otherwise(0.0)
    return joined.withColumn("dom_dga_prob", score)


# --- all of it, once per endpoint ------------------------------------------------------------------
def enrich_distinct(
    flows: DataFrame,
    otx: DataFrame,
    urlhaus: DataFrame,
    lists: DataFrame,
    dga: DataFrame,
    as_of: dt.datetime,
    order: str = "report_id",
    spread: str = "flow_id",
    source: DataFrame | None = None,
) -> DataFrame:
    """Look every distinct (DstIP, SNI) up once and join the answers back to all flows.

    ``source`` is the client table the flows come from: its keys are a superset of the flows' keys and
    cheaper to scan than the paired flows.
    """
    source = flows if source is None else source
    keys = ["DstIP", "SNI"]
    endpoints = source.select(*keys).distinct()
    known = otx_lookup(endpoints, otx, order, spread="SNI")
    known = urlhaus_lookup(known, urlhaus, order, as_of, spread="DstIP", hot_source=endpoints)
    known = domain_popularity(known, lists, as_of.date(), spread="DstIP", wanted=source)
    known = dga_score(known, dga, spread="DstIP", hot_source=endpoints)
    return attach(flows, known, keys, [spread], distinct_estimate(source, keys), source)
