"""Pair client hellos with server hellos on the reversed 4-tuple."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.operators.skew import rank_in_group, salted_join
from flowscope.schema import ENDPOINT_KEYS

SERVER_PREFIX = "srv_"


def reversed_servers(servers: DataFrame) -> DataFrame:
    """Server columns under ``srv_`` and the 4-tuple turned round to the client's point of view."""
    rest = [c for c in servers.columns if c not in ENDPOINT_KEYS]
    return servers.select(
        F.col("DstIP").alias("SrcIP"),
        F.col("DstPort").alias("SrcPort"),
        F.col("SrcIP").alias("DstIP"),
        F.col("SrcPort").alias("DstPort"),
        *[F.col(c).alias(SERVER_PREFIX + c) for c in rest],
    )


def first_servers(servers: DataFrame, server_id: str) -> DataFrame:
    """The first server record in file order for each 4-tuple.

    Only ids are aggregated, combined map-side; the records are fetched by tuple and id, which spreads a hot tuple.
    """
    turned, ident = reversed_servers(servers), SERVER_PREFIX + server_id
    first = turned.groupBy(*ENDPOINT_KEYS).agg(F.min(ident).alias(ident))
    return turned.join(first, [*ENDPOINT_KEYS, ident], "left_semi")


def pair_first_match(
    clients: DataFrame, servers: DataFrame, client_id: str = "flow_id", server_id: str = "flow_id"
) -> DataFrame:
    """Every client with the first matching server; clients without one are left out."""
    return salted_join(clients, first_servers(servers, server_id), ENDPOINT_KEYS, [client_id])


def pair_one_to_one(
    clients: DataFrame, servers: DataFrame, client_id: str = "flow_id", server_id: str = "flow_id"
) -> DataFrame:
    """The k-th client of a 4-tuple with its k-th server, each server used once."""
    ranked_clients = rank_in_group(clients, ENDPOINT_KEYS, client_id, "pair_rank")
    turned = reversed_servers(servers)
    ranked_servers = rank_in_group(turned, ENDPOINT_KEYS, SERVER_PREFIX + server_id, "pair_rank")
    return ranked_clients.join(ranked_servers, [*ENDPOINT_KEYS, "pair_rank"])


def unpaired_clients(clients: DataFrame, servers: DataFrame, client_id: str = "flow_id") -> DataFrame:
    """Clients without any server, the rejects of both pairings' key match."""
    known = reversed_servers(servers.select(*ENDPOINT_KEYS)).distinct().withColumn("_paired", F.lit(True))
    marked = salted_join(clients, known, ENDPOINT_KEYS, [client_id], "left")
    return marked.where(F.col("_paired").isNull()).drop("_paired")
