"""Pair client with server hellos while both arrive.

Records carry an event time. Pairing goes by time windows: a client meets the servers of its own window. A window is
closed when the watermark, the latest time seen less ``delay``, has passed its end; records that come more than a micro-batch
later than that are left out. After all input and a closing record beyond the last window, the results are those of the batch pairing of each
window.

* ``first_match``: the server of smallest id of each 4-tuple and window is an incremental aggregate, combined before its
  exchange; clients wait for it in a stream-stream join. Clients of a 4-tuple are spread over ``salts`` partitions, so a
  hot 4-tuple fills no task's state.
* ``one_to_one``: the k-th client of a 4-tuple with its k-th server, in order of arrival: by micro-batch, and by id within
  one. Each micro-batch is a batch job over its rows and those that still wait, so hot 4-tuples are ranked in pieces as
  in the batch pairing. Pairs and the next waiting rows are batches that take effect once, so a micro-batch that runs
  again after a failure changes nothing.

Duplicates: a client that arrives twice is paired twice by ``first_match``, a repeated server changes nothing; ``one_to_one``
counts every record.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from flowscope.operators.pairing import SERVER_PREFIX, reversed_servers
from flowscope.operators.skew import rank_in_group, salted_join
from flowscope.schema import ENDPOINT_KEYS
from flowscope.session import materialized
from flowscope.sources.batches import append_once, read_batches


def first_match(
    clients: DataFrame,
    servers: DataFrame,
    time: str = "ts",
    window: str = "1 day",
    delay: str = "1 hour",
    client_id: str = "flow_id",
    server_id: str = "flow_id",
    salts: int = 16,
) -> DataFrame:
    """Every client with the first server of its 4-tuple in its window; a stream for ``append``."""
    turned = reversed_servers(servers.withWatermark(time, delay))
    rest = [c for c in turned.columns if c not in ENDPOINT_KEYS]
    first = turned.groupBy(F.window(SERVER_PREFIX + time, window).alias("span"), *ENDPOINT_KEYS).agg(
        F.min_by(F.struct(*rest), F.col(SERVER_PREFIX + server_id)).alias("first")
    )
    copies = first.select("span", *ENDPOINT_KEYS, "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64(client_id), F.lit(salts)).cast("int").alias("salt")
    # the window is the one event time from here on: those of the records are plain columns of structs
    record = F.struct(*clients.columns).alias("record")
    waiting = clients.withWatermark(time, delay).select(*ENDPOINT_KEYS, record, F.window(time, window).alias("span"), salt)
    pairs = waiting.join(copies, ["span", "salt", *ENDPOINT_KEYS])
    plain = lambda of, names: [F.col(of)[c].alias(c, metadata={}) for c in names]
    return pairs.select(*plain("record", clients.columns), *plain("first", rest))


def one_to_one(spark: SparkSession, folder: str, client_schema: StructType, server_schema: StructType, client_id: str = "flow_id", server_id: str = "flow_id"):
    """A function for ``foreachBatch`` over rows of ``sides``, and one that reads the pairs so far.

    Records keep the rank of their arrival within their 4-tuple; a pair has the same rank on both sides. What has
    no partner yet waits under ``folder``, one version for each micro-batch.
    """
    ranked_client = StructType([*client_schema.fields]).add("pair_rank", LongType())
    turned_schema = reversed_servers(spark.createDataFrame([], server_schema)).schema
    ranked_server = StructType([*turned_schema.fields]).add("pair_rank", LongType())
    counted = StructType([f for f in client_schema.fields if f.name in ENDPOINT_KEYS]).add("n", LongType())
    paired = StructType([*ranked_client.fields, *[f for f in turned_schema.fields if f.name not in ENDPOINT_KEYS]])

    def version(name: str, batch: int, schema: StructType) -> DataFrame:
        return read_batches(spark, f"{folder}/{name}/{batch}", schema)

    def arrived(rows: DataFrame, name: str, batch: int, ident: str) -> DataFrame:
        """The batch's rows with their ranks; the numbers of all rows so far become the next version."""
        before = version(f"{name}_counts", batch - 1, counted)
        ranked = rank_in_group(rows, ENDPOINT_KEYS, ident, "place")
        ranked = salted_join(ranked, before, ENDPOINT_KEYS, [ident], "left")
        ranked = ranked.withColumn("pair_rank", (F.col("place") + F.coalesce("n", F.lit(0))).cast("bigint")).drop("place", "n")
        added = rows.groupBy(*ENDPOINT_KEYS).agg(F.count("*").alias("n"))
        total = before.unionByName(added).groupBy(*ENDPOINT_KEYS).agg(F.sum("n").cast("bigint").alias("n"))
        append_once(total, f"{folder}/{name}_counts/{batch}", "counts")
        return ranked

    def work(batch_rows: DataFrame, batch: int) -> None:
        rows = materialized(batch_rows, "arrived")
        clients = rows.where("client is not null").select("client.*")
        servers = rows.where("server is not null").select("server.*")
        new_clients = arrived(clients, "clients", batch, client_id).select(*ranked_client.fieldNames())
        new_servers = arrived(reversed_servers(servers), "servers", batch, SERVER_PREFIX + server_id).select(*ranked_server.fieldNames())
        waiting_clients = materialized(version("waiting_clients", batch - 1, ranked_client).unionByName(new_clients), "clients")
        waiting_servers = materialized(version("waiting_servers", batch - 1, ranked_server).unionByName(new_servers), "servers")
        keys = [*ENDPOINT_KEYS, "pair_rank"]
        pairs = waiting_clients.join(waiting_servers, keys).select(*paired.fieldNames())
        append_once(pairs, f"{folder}/pairs", f"batch {batch}")
        append_once(waiting_clients.join(waiting_servers.select(*keys), keys, "left_anti"), f"{folder}/waiting_clients/{batch}", "rows")
        append_once(waiting_servers.join(waiting_clients.select(*keys), keys, "left_anti"), f"{folder}/waiting_servers/{batch}", "rows")

    def pairs() -> DataFrame:
        return read_batches(spark, f"{folder}/pairs", paired)

    return work, pairs


def sides(clients: DataFrame, servers: DataFrame) -> DataFrame:
    """Both streams as one: (client, server), one of which is null."""
    client, server = F.struct(*clients.columns).alias("client"), F.struct(*servers.columns).alias("server")
    left = clients.select(client).withColumn("server", F.lit(None).cast(servers.schema))
    return left.unionByName(servers.select(server).withColumn("client", F.lit(None).cast(clients.schema)))


def run_available(stream: DataFrame, folder: str, sink: str | Callable[[DataFrame, int], None]) -> None:
    """Process all input that is there and stop; ``folder`` keeps the stream's progress, ``sink`` is a path or a function of a
    micro-batch."""
    writer = stream.writeStream.option("checkpointLocation", folder).trigger(availableNow=True).outputMode("append")
    query = writer.format("parquet").start(sink) if isinstance(sink, str) else writer.foreachBatch(sink).start()
    query.awaitTermination()
