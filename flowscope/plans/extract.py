"""Handshake records to features: pair, enrich, encode."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.operators import encode, enrich, pairing
from flowscope.schema import LABEL


@dataclass(frozen=True)
class Intelligence:
    """Snapshots the flows are judged by. ``report_order`` ranks reports on the same key."""

    blacklist: DataFrame
    otx: DataFrame
    urlhaus: DataFrame
    popularity: DataFrame
    dga: DataFrame
    as_of: dt.datetime
    report_order: str = "report_id"


def blacklisted_by_class(clients: DataFrame, servers: DataFrame, blacklist: DataFrame, label: str = LABEL) -> DataFrame:
    """Paired flows and those among them with a blacklisted fingerprint, per class."""
    narrow = clients.select("flow_id", "SrcIP", "SrcPort", "DstIP", "DstPort", "Ja3", label)
    flows = pairing.pair_first_match(narrow, servers.select("flow_id", "SrcIP", "SrcPort", "DstIP", "DstPort"))
    listed = enrich.ja3_lookup(flows, blacklist, hot_source=narrow)
    return listed.groupBy(label).agg(
        F.count("*").alias("flows"), F.count_if(F.col("ja3_urlhaus_status") == 1).alias("blacklisted")
    )


def extract_flows(
    clients: DataFrame,
    servers: DataFrame,
    intelligence: Intelligence,
    label: int | Column = 0,
    one_to_one: bool = False,
    stop_at_error: bool = False,
) -> DataFrame:
    """Paired and enriched flows with their code weights, before the wide layout."""
    pair = pairing.pair_one_to_one if one_to_one else pairing.pair_first_match
    flows = pair(clients, servers)
    flows = enrich.enrich_distinct(
        flows,
        intelligence.otx,
        intelligence.urlhaus,
        intelligence.popularity,
        intelligence.dga,
        intelligence.as_of,
        intelligence.report_order,
        source=clients,
    )
    flows = enrich.ja3_lookup(flows, intelligence.blacklist, hot_source=clients)
    weigh = encode.weigh_codes_stop_at_error if stop_at_error else encode.weigh_codes
    return encode.with_scalars(weigh(flows), label)


def extract_features(clients: DataFrame, servers: DataFrame, intelligence: Intelligence, label: int | Column = 0, **modes) -> DataFrame:
    """``flow_id`` and the 519 columns."""
    return encode.encode_wide(extract_flows(clients, servers, intelligence, label, **modes), keep=["flow_id"])
