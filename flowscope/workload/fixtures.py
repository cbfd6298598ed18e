"""Stand-in inputs derived from the benchmark tables by SQL that Spark and DuckDB both run.

Every event is one client hello and one server hello; 4-tuples repeat, some clients have no server, and the
code lists hold unknown and repeated codes.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.plans.extract import Intelligence
from flowscope.schema import URLHAUS_REPORT
from flowscope.sources.intel import parse_otx_report

AS_OF = dt.datetime(2024, 1, 31, 0, 0, 0)

DESTINATION = (
    "CASE user_id % 4 WHEN 0 THEN concat('192.168.1.', user_id % 250) WHEN 1 THEN concat('8.8.4.', user_id % 250) "
    "WHEN 2 THEN concat('172.32.0.', user_id % 250) ELSE concat('100.20.30.', user_id % 250) END"
)
CLIENT = f"""
SELECT event_id AS flow_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS malware_label,
  concat('10.0.', user_id % 200, '.', user_id % 20) AS SrcIP, CAST(40000 + user_id % 7 AS STRING) AS SrcPort,
  {DESTINATION} AS DstIP,
  CASE WHEN user_id % 5 = 0 THEN '8443' ELSE '443' END AS DstPort,
  CASE WHEN event_id % 6 = 0 THEN '' ELSE concat('host', user_id % 1000, '.example.com') END AS SNI,
  md5(concat('ja3:', user_id)) AS Ja3, '22' AS Type, '769' AS Version,
  CAST(200 + event_id % 300 AS STRING) AS MessageLen, '1' AS HandshakeType, '771' AS HandshakeVersion,
  CAST(196 + event_id % 300 AS STRING) AS HandshakeLen, '8' AS CipherSuiteLen,
  CAST(100 + user_id % 50 AS STRING) AS ExtensionLen,
  concat('(', 4865 + event_id % 5, '-', 47 + user_id % 30, '-', 47 + user_id % 30, '-2570)') AS CipherSuites,
  CASE WHEN event_id % 10 = 0 THEN '()' ELSE concat('(1027-2052-', 1796 + event_id % 16, ')') END AS SignatureAlgs,
  concat('(29-23-2570-', 24 + user_id % 3, ')') AS SupportedGroups,
  CASE WHEN user_id % 3 = 0 THEN '0' ELSE '(0-1-2)' END AS SupportedPoints
FROM events"""
SERVER = f"""
SELECT event_id AS flow_id, {DESTINATION} AS SrcIP,
  CASE WHEN user_id % 11 = 3 THEN '9443' WHEN user_id % 5 = 0 THEN '8443' ELSE '443' END AS SrcPort,
  concat('10.0.', user_id % 200, '.', user_id % 20) AS DstIP, CAST(40000 + user_id % 7 AS STRING) AS DstPort,
  '771' AS Version, CASE WHEN event_id % 3 = 0 THEN '772' ELSE '0' END AS SupportedVersion,
  CASE WHEN event_id % 3 = 1 THEN 'false' ELSE 'true' END AS OCSPStapling,
  CASE WHEN event_id % 4 = 1 THEN '29' ELSE '24' END AS SelectedGroup,
  CASE WHEN event_id % 7 = 0 THEN '2570' ELSE CAST(4865 + event_id % 5 AS STRING) END AS CipherSuite,
  CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '65281' ELSE '(0-23-54-65281)' END AS Extensions
FROM events"""
BLACKLIST = """
SELECT md5(concat('ja3:', s_suppkey * 3)) AS ja3,
  concat('2018-0', 1 + s_suppkey % 9, '-1', s_suppkey % 10, ' 06:30:00') AS first_seen,
  concat('2020-11-2', s_suppkey % 9, ' 05:00:00') AS last_seen, s_name AS reason
FROM supplier"""
OTX = """
SELECT c_custkey AS report_id,
  CASE c_custkey % 6 WHEN 0 THEN concat('192.168.1.', c_custkey % 250) WHEN 1 THEN concat('8.8.4.', c_custkey % 250)
    WHEN 2 THEN concat('172.32.0.', c_custkey % 250) WHEN 3 THEN concat('100.20.30.', c_custkey % 250)
    ELSE concat('203.0.', c_custkey % 250, '.7') END AS ip,
  concat('{"pulse_info":{"pulses":', CASE c_custkey % 4 WHEN 0 THEN '[]' ELSE '[{"id":"a"},{"id":"b"}]' END, '}}') AS general,
  concat('{"passive_dns":', CASE c_custkey % 5 WHEN 0 THEN '[]' ELSE
    concat('[{"first":"2021-03-0', 1 + c_custkey % 9, 'T10:00:00","last":"2022-0', 1 + c_custkey % 9, '-1', c_custkey % 10,
    'T09:59:00"},{"first":"2019-0', 1 + c_custkey % 9, '-11T11:00:00","last":"2020-01-01T00:00:00"}]') END, '}') AS passive_dns
FROM customer"""
URLHAUS = """
SELECT c_custkey AS report_id,
  concat('{"host":"', CASE c_custkey % 3 WHEN 0 THEN concat('host', c_custkey % 1000, '.example.com')
    WHEN 1 THEN concat('8.8.4.', c_custkey % 250) ELSE concat('100.20.30.', c_custkey % 250) END,
    '","query_status":"', CASE c_custkey % 5 WHEN 0 THEN 'no_results' ELSE 'ok' END,
    '","firstseen":"2022-0', 1 + c_custkey % 9, '-1', c_custkey % 10, ' 12:00:00 UTC","urls":',
    CASE c_custkey % 7 WHEN 0 THEN '[]' WHEN 1 THEN '[{"url_status":"offline"}]' WHEN 2 THEN '[{"url_status":"unknown"}]'
      ELSE '[{"url_status":"online"},{"url_status":"offline"}]' END, '}') AS doc
FROM customer"""
POPULARITY = """
SELECT DISTINCT CAST(ts AS DATE) AS list_date, CAST(1 + user_id % 1000 AS INT) AS rank,
  concat('host', user_id % 1000, '.example.com') AS domain
FROM events"""
DGA = """
SELECT concat('host', c_custkey % 1000, '.example.com') AS domain, max(CAST(c_custkey % 97 AS DOUBLE) / 97) AS prob
FROM customer GROUP BY concat('host', c_custkey % 1000, '.example.com')"""

# a numeric feature table: row id, class label, live columns, a constant and an all-zero column
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "const_one", "all_zero"]
LIVE = FEATURES[:5]
TABLE = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_quantity) AS INT),
    CAST(round(l_extendedprice * 100) AS BIGINT), CAST(round(l_discount * 100) AS INT), CAST(round(l_tax * 100) AS INT),
    CAST(CAST(l_shipdate AS DATE) AS STRING)) AS row_id,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS malware_label,
  l_quantity, l_extendedprice, l_discount, l_tax, CAST(l_linenumber AS DOUBLE) AS l_linenumber,
  CAST(1.0 AS DOUBLE) AS const_one, CAST(0.0 AS DOUBLE) AS all_zero
FROM lineitem"""

VIEWS = {
    "client_hello": CLIENT,
    "server_hello": SERVER,
    "blacklist": BLACKLIST,
    "otx_raw": OTX,
    "urlhaus_raw": URLHAUS,
    "popularity": POPULARITY,
    "dga": DGA,
    "feature_table": TABLE,
}

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    run: Query
    sql: str | None = None


class Registry(dict):
    """``name -> Registered``, filled by decorator."""

    def add(self, name: str, sql: str | None = None):
        def register(run: Query) -> Query:
            assert name not in self, name
            self[name] = Registered(run, sql)
            return run

        return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the stand-in views as a DataFrame."""
    text = VIEWS[name]
    for source in set(re.findall(r"FROM (\w+)", text)):
        table(spark, sf, source).createOrReplaceTempView(source)
    return spark.sql(text)


def with_views(*names: str) -> str:
    """``WITH`` clause with the views for the SQL twin; continue it with ``, more AS (...) SELECT``."""
    return "WITH " + ", ".join(f"{name} AS ({VIEWS[name]})" for name in names)


def otx_reports(spark: SparkSession, sf: str) -> DataFrame:
    raw = view(spark, sf, "otx_raw")
    return raw.select("report_id", "ip", *parse_otx_report(F.col("general"), F.col("passive_dns")))


def urlhaus_reports(spark: SparkSession, sf: str) -> DataFrame:
    raw = view(spark, sf, "urlhaus_raw")
    return raw.select("report_id", F.from_json("doc", URLHAUS_REPORT).alias("d")).select("report_id", "d.*")


def intelligence(spark: SparkSession, sf: str) -> Intelligence:
    return Intelligence(
        view(spark, sf, "blacklist"),
        otx_reports(spark, sf),
        urlhaus_reports(spark, sf),
        view(spark, sf, "popularity"),
        view(spark, sf, "dga"),
        AS_OF,
    )


def embeddings(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """``vec_id``, binary label and the 64 vector components as columns ``e0..e63``."""
    raw = table(spark, sf, "embeddings")
    names = [f"e{i}" for i in range(64)]
    parts = [F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)]
    return raw.select("vec_id", (F.col("label") % 2).alias("malware_label"), *parts), names
