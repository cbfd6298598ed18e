"""Enrichment of arriving batches that looks every endpoint up once for all of them.

The answers are kept as a table of batches next to the snapshot they came from (``version``): a batch looks up only the
endpoints that no committed batch holds, adds them with one atomic commit, and is then enriched from the table. A rerun
of a batch finds its endpoints and looks nothing up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from flowscope.operators.enrich import enrich_distinct
from flowscope.operators.skew import attach, distinct_estimate
from flowscope.plans.extract import Intelligence
from flowscope.sources.batches import append_once, read_batches

KEYS = ["DstIP", "SNI"]
NUMBERS = ["otx_status", "otx_age", "urlhaus_status", "urlhaus_age", "dom_in_tranco_1m", "dom_dga_prob"]
ANSWERS = StructType([*[StructField(c, StringType()) for c in KEYS], *[StructField(c, DoubleType()) for c in NUMBERS]])


def unseen_endpoints(flows: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct endpoints of the flows that ``known`` has no answers for."""
    endpoints = flows.select(*KEYS).distinct()
    same = [endpoints[c].eqNullSafe(known[c]) for c in KEYS]
    return endpoints.join(known, same[0] & same[1], "left_anti")


def look_up_batch(flows: DataFrame, intelligence: Intelligence, folder: str, version: str, batch: str) -> DataFrame:
    """Add the answers for the batch's unseen endpoints to the table under ``folder``; returns the whole table."""
    spark, path = flows.sparkSession, f"{folder}/{version}"
    fresh = unseen_endpoints(flows, read_batches(spark, path, ANSWERS))
    looked_up = enrich_distinct(
        fresh,
        intelligence.otx,
        intelligence.urlhaus,
        intelligence.popularity,
        intelligence.dga,
        intelligence.as_of,
        intelligence.report_order,
        spread="DstIP",
    )
    answers = looked_up.select(*[F.col(f.name).cast(f.dataType) for f in ANSWERS.fields])
    append_once(answers, path, batch)
    return read_batches(spark, path, ANSWERS)


def enrich_batch(flows: DataFrame, intelligence: Intelligence, folder: str, version: str, batch: str, spread: str = "flow_id") -> DataFrame:
    """The flows of a batch with the answers of ``enrich_distinct``."""
    known = look_up_batch(flows, intelligence, folder, version, batch)
    # copies of an endpoint in the table (two batches at once) have the same answers
    return attach(flows, known.dropDuplicates(KEYS), KEYS, [spread], distinct_estimate(flows, KEYS), flows)
