"""Handshake sources, code functions, pairing, enrichment and encoding."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowscope import schema as S
from flowscope.detectors import names
from flowscope.functions import codes, documents, net, temporal
from flowscope.operators import columns, encode, enrich, evaluate, pairing
from flowscope.operators.profile import class_measures
from flowscope.operators.summary import summarize_vector
from flowscope.plans import extract, incremental
from flowscope.session import materialized, scratch_path
from flowscope.sources import hello, intel, tables
from flowscope.streaming import pairing as streaming
from flowscope.workload import fixtures as fx
from flowscope.workload.fixtures import Registry, table, view, with_views

FLOWS = Registry()

HELLO_FIELDS = ", ".join(S.CLIENT_HELLO.fieldNames())
SERVER_FIELDS = ", ".join(S.SERVER_HELLO.fieldNames())
KEYS = ", ".join(S.ENDPOINT_KEYS)
FIRST = f"""first_server AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY flow_id) AS rn
  FROM server_hello) WHERE rn = 1)"""
SERVER_COLUMNS = ", ".join(
    f"s.{c} AS srv_{c}" for c in ["flow_id", *[f for f in S.SERVER_HELLO.fieldNames() if f not in S.ENDPOINT_KEYS]]
)
MATCH = "s.SrcIP = c.DstIP AND s.DstIP = c.SrcIP AND s.SrcPort = c.DstPort AND s.DstPort = c.SrcPort"
PAIRED = f"{FIRST}, paired AS (SELECT c.*, {SERVER_COLUMNS} FROM client_hello c JOIN first_server s ON {MATCH})"
WITH_PAIRED = with_views("client_hello", "server_hello") + ", " + PAIRED


def clients(spark, sf):
    return view(spark, sf, "client_hello")


def servers(spark, sf):
    return view(spark, sf, "server_hello")


def paired(spark, sf):
    return pairing.pair_first_match(clients(spark, sf), servers(spark, sf))


# --- sources and sinks -----------------------------------------------------------------------------
@FLOWS.add("client_hello_csv", with_views("client_hello") + f" SELECT {HELLO_FIELDS} FROM client_hello")
def client_hello_csv(spark, sf):
    path = scratch_path(spark, "clients")
    tables.write_table(clients(spark, sf).select(*S.CLIENT_HELLO.fieldNames()), path, "csv")
    return hello.read_client_hello(spark, path, with_id=False)


@FLOWS.add("server_hello_csv", with_views("server_hello") + f" SELECT {SERVER_FIELDS} FROM server_hello")
def server_hello_csv(spark, sf):
    path = scratch_path(spark, "servers")
    tables.write_table(servers(spark, sf).select(*S.SERVER_HELLO.fieldNames()), path, "csv")
    return hello.read_server_hello(spark, path, with_id=False)


@FLOWS.add("pair_file_order", WITH_PAIRED + f" SELECT {KEYS}, MessageLen, srv_CipherSuite, srv_OCSPStapling, srv_Extensions FROM paired")
def pair_file_order(spark, sf):
    """Client and server records in many files, half of them with another header: the first server is the first in file order."""
    path = scratch_path(spark, "captures")
    middle = table(spark, sf, "events").agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]

    def files(records, fields, name):
        ordered = records.orderBy("flow_id")
        for part, rows, columns in (("a", F.col("flow_id") <= middle, fields), ("b", F.col("flow_id") > middle, ["extra", *reversed(fields)])):
            tables.write_table(ordered.where(rows).withColumn("extra", F.lit("x")).select(*columns), f"{path}/{name}/{part}", "csv")
        return [f"{path}/{name}/{part}" for part in "ab"]

    client_files = files(clients(spark, sf), S.CLIENT_HELLO.fieldNames(), "clients")
    server_files = files(servers(spark, sf), S.SERVER_HELLO.fieldNames(), "servers")
    pairs = pairing.pair_first_match(hello.read_client_hello(spark, client_files), hello.read_server_hello(spark, server_files))
    return pairs.select(*S.ENDPOINT_KEYS, "MessageLen", "srv_CipherSuite", "srv_OCSPStapling", "srv_Extensions")


@FLOWS.add("blacklist_csv", with_views("blacklist") + " SELECT * FROM blacklist")
def blacklist_csv(spark, sf):
    """A headerless file whose comment lines are skipped."""
    path = scratch_path(spark, "blacklist")
    lines = view(spark, sf, "blacklist").select(F.concat_ws(",", "ja3", "first_seen", "last_seen", "reason").alias("value"))
    lines.union(lines.select(F.concat(F.lit("# "), "value"))).write.text(path)
    return intel.read_blacklist(spark, path)


@FLOWS.add(
    "otx_reports_json",
    with_views("otx_raw")
    + """ SELECT ip, json_array_length(general, '$.pulse_info.pulses') AS pulses,
      json_array_length(passive_dns, '$.passive_dns') AS records,
      json_extract_string(passive_dns, '$.passive_dns[0].last') AS newest FROM otx_raw""",
)
def otx_reports_json(spark, sf):
    path = scratch_path(spark, "otx")
    tables.write_table(fx.otx_reports(spark, sf).drop("report_id"), path, "json")
    reports = intel.read_otx_reports(spark, path)
    return reports.select(
        "ip",
        F.size("general.pulse_info.pulses").cast("bigint").alias("pulses"),
        F.size("passive_dns.passive_dns").cast("bigint").alias("records"),
        intel.report_value(reports, ["passive_dns", "passive_dns", "last"]).alias("newest"),
    )


@FLOWS.add(
    "urlhaus_reports_json",
    with_views("urlhaus_raw")
    + """ SELECT json_extract_string(doc, '$.host') AS host, json_extract_string(doc, '$.query_status') AS query_status,
      json_extract_string(doc, '$.firstseen') AS firstseen, json_extract_string(doc, '$.urls[0].url_status') AS first_status
      FROM urlhaus_raw""",
)
def urlhaus_reports_json(spark, sf):
    path = scratch_path(spark, "urlhaus")
    tables.write_table(fx.urlhaus_reports(spark, sf).drop("report_id"), path, "json")
    reports = intel.read_urlhaus_reports(spark, path)
    first = intel.report_value(reports, ["urls", "url_status"]).alias("first_status")
    return reports.select("host", "query_status", "firstseen", first)


@FLOWS.add(
    "popularity_top_n",
    with_views("popularity")
    + " SELECT list_date, rank, domain FROM popularity WHERE rank <= 50 AND list_date BETWEEN DATE '2024-01-16' AND DATE '2024-01-29'",
)
def popularity_top_n(spark, sf):
    """Top 50 of each daily list in a date window, from a table partitioned by date."""
    path = scratch_path(spark, "popularity")
    intel.write_popularity(view(spark, sf, "popularity"), path)
    lists = intel.read_popularity(spark, path, dt.date(2024, 1, 16), dt.date(2024, 1, 29), 50)
    return lists.select("list_date", "rank", "domain")


FEATURE_FILE_SQL = WITH_PAIRED + """ SELECT malware_label, count(*) AS n, sum(CAST(MessageLen AS DOUBLE)) AS message_len,
  sum(CAST(srv_SupportedVersion AS DOUBLE)) AS svr_supported_ver FROM paired GROUP BY malware_label"""


def _class_sums(features):
    sums = [F.sum(c).alias(c) for c in ("message_len", "svr_supported_ver")]
    return features.groupBy("malware_label").agg(F.count("*").alias("n"), *sums)


def _weighed(spark, sf):
    """Paired flows with their weights, written once: each class is a job of its own."""
    return materialized(encode.with_scalars(encode.weigh_codes(paired(spark, sf)), F.col("malware_label")), "weighed")


def _feature_file(spark, sf, fmt):
    """Append each class as its own job, then read all of it back."""
    path, weighed = scratch_path(spark, "features"), _weighed(spark, sf)
    for value in (0, 1):
        tables.write_features(encode.encode_wide(encode.dealt(weighed.where(F.col("malware_label") == value))), path, fmt)
    return _class_sums(tables.read_features(spark, path, fmt))


# --- functions -------------------------------------------------------------------------------------
def _codes_sql(column: str) -> str:
    return f"""SELECT flow_id, code FROM (SELECT flow_id, TRY_CAST(t AS INTEGER) AS code FROM (SELECT flow_id,
      unnest(string_split(CASE WHEN starts_with({column}, '(') THEN substr({column}, 2, length({column}) - 2)
      ELSE {column} END, '-')) AS t FROM client_hello)) WHERE code IS NOT NULL"""


@FLOWS.add("parse_code_list", with_views("client_hello") + " " + _codes_sql("SignatureAlgs"))
def parse_code_list(spark, sf):
    parsed = codes.parse_code_list(F.col("SignatureAlgs"))
    return clients(spark, sf).select("flow_id", F.explode(parsed).alias("code"))


@FLOWS.add("parse_points", with_views("client_hello") + " " + _codes_sql("SupportedPoints"))
def parse_points(spark, sf):
    """Lists that may be bare scalars."""
    return clients(spark, sf).select("flow_id", F.explode(codes.parse_code_list(F.col("SupportedPoints"))).alias("code"))


@FLOWS.add("hex_code", "SELECT o_orderkey, printf('%04x', o_custkey * 97) AS code FROM orders")
def hex_code(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", codes.hex_code(F.col("o_custkey") * 97).alias("code"))


@FLOWS.add("pad_code", "SELECT l_orderkey, printf('%02d', l_linenumber) AS code, printf('%02d', l_partkey) AS wide FROM lineitem")
def pad_code(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.select(
        "l_orderkey", codes.pad_code(F.col("l_linenumber")).alias("code"), codes.pad_code(F.col("l_partkey")).alias("wide")
    )


@FLOWS.add(
    "age_days",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(trunc((epoch(TIMESTAMP '1999-06-17 18:30:00') - epoch(l_shipdate))
      / 86400) AS BIGINT) AS age FROM lineitem""",
)
def age_days(spark, sf):
    end = F.lit(dt.datetime(1999, 6, 17, 18, 30)).cast("timestamp")
    age = temporal.age_days(F.col("l_shipdate").cast("timestamp"), end).alias("age")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", age)


@FLOWS.add(
    "parse_ts",
    with_views("blacklist")
    + """ SELECT ja3, strftime(try_strptime(first_seen, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS first_seen,
      strftime(try_strptime(last_seen, '%Y-%d-%m %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS swapped FROM blacklist""",
)
def parse_ts(spark, sf):
    shown = lambda c, fmt: F.date_format(temporal.parse_ts(F.col(c), fmt), "yyyy-MM-dd HH:mm:ss")
    return view(spark, sf, "blacklist").select(
        "ja3",
        shown("first_seen", temporal.BLACKLIST_FORMAT).alias("first_seen"),
        shown("last_seen", temporal.BLACKLIST_SWAPPED_FORMAT).alias("swapped"),
    )


@FLOWS.add(
    "date_range",
    """SELECT o_orderkey, CAST(unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 3, INTERVAL 1 DAY)) AS DATE)
      AS day FROM orders""",
)
def date_range(spark, sf):
    """The days from an order's date to three days later."""
    start = F.col("o_orderdate").cast("date")
    days = temporal.days_between(start, F.date_add(start, 3))
    return table(spark, sf, "orders").select("o_orderkey", F.explode(days).alias("day"))


@FLOWS.add("json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_path(spark, sf):
    props = F.col("props")
    return table(spark, sf, "events").select(
        "event_id", documents.json_path(props, ["k"]).alias("k"), documents.json_path(props, ["missing"]).alias("missing")
    )


PRIVATE_SQL = " OR ".join(
    f"ip BETWEEN {int(n.network_address)} AND {int(n.broadcast_address)}"
    for n in map(net.ipaddress.IPv4Network, net.PRIVATE_IPV4)
)
ADDRESSES = "SELECT event_id, concat(event_id % 256, '.', (event_id * 7) % 256, '.', user_id % 256, '.', event_id % 300) AS address FROM events"


def addresses(spark, sf):
    """Addresses all over the space; the last part may be out of range."""
    table(spark, sf, "events").createOrReplaceTempView("events")
    return spark.sql(ADDRESSES)


@FLOWS.add(
    "is_private_ip",
    f"""WITH a AS ({ADDRESSES}), b AS (SELECT event_id, address, string_split(address, '.') AS p FROM a),
      c AS (SELECT event_id, address, CASE WHEN CAST(p[4] AS INT) < 256 THEN ((CAST(p[1] AS BIGINT) * 256 + CAST(p[2] AS BIGINT)) * 256
        + CAST(p[3] AS BIGINT)) * 256 + CAST(p[4] AS BIGINT) END AS ip FROM b)
      SELECT event_id, address, coalesce({PRIVATE_SQL}, false) AS private FROM c""",
)
def is_private_ip(spark, sf):
    return addresses(spark, sf).withColumn("private", net.is_private_ip(F.col("address")))


@FLOWS.add(
    "is_ipv4",
    f"""WITH a AS ({ADDRESSES}), b AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN address WHEN 1 THEN concat(address, '/', event_id % 35)
        ELSE concat(address, 'x') END AS text, CAST(string_split(address, '.')[4] AS INT) AS last, address FROM a),
      c AS (SELECT *, string_split(address, '.') AS p FROM b),
      d AS (SELECT *, ((CAST(p[1] AS BIGINT) * 256 + CAST(p[2] AS BIGINT)) * 256 + CAST(p[3] AS BIGINT)) * 256 + last AS ip FROM c)
      SELECT event_id, text, CASE event_id % 3 WHEN 0 THEN last < 256
        WHEN 1 THEN last < 256 AND event_id % 35 <= 32
          AND ip % CAST(pow(2, greatest(32 - event_id % 35, 0)) AS BIGINT) = 0
        ELSE false END AS valid FROM d""",
)
def is_ipv4(spark, sf):
    text = (
        F.when(F.col("event_id") % 3 == 0, F.col("address"))
        .when(F.col("event_id") % 3 == 1, F.concat("address", F.lit("/"), (F.col("event_id") % 35).cast("string")))
        .otherwise(F.concat("address", F.lit("x")))
    )
    rows = addresses(spark, sf).select("event_id", text.alias("text"))
    return rows.withColumn("valid", net.is_ipv4(F.col("text")))


# --- scalars ---------------------------------------------------------------------------------------
@FLOWS.add(
    "client_scalars",
    with_views("client_hello")
    + " SELECT flow_id, "
    + ", ".join(f"CAST({field} AS DOUBLE) AS {name}" for name, field in S.CLIENT_SCALARS.items())
    + " FROM client_hello",
)
def client_scalars(spark, sf):
    return clients(spark, sf).select("flow_id", *encode.client_scalars())


@FLOWS.add(
    "server_versions",
    with_views("server_hello")
    + " SELECT flow_id, CAST(Version AS DOUBLE) AS svr_tls_ver, CAST(SupportedVersion AS DOUBLE) AS svr_supported_ver FROM server_hello",
)
def server_versions(spark, sf):
    return servers(spark, sf).select("flow_id", *encode.server_versions(prefix=""))


@FLOWS.add(
    "ocsp_flag",
    with_views("server_hello")
    + " SELECT flow_id, CASE WHEN OCSPStapling = 'false' THEN 0.0 ELSE 1.0 END::DOUBLE AS svr_ocsp_staple FROM server_hello",
)
def ocsp_flag(spark, sf):
    return servers(spark, sf).select("flow_id", encode.ocsp_flag(prefix=""))


@FLOWS.add(
    "sni_guard",
    with_views("client_hello")
    + " SELECT flow_id, CASE WHEN SNI <> '' THEN length(SNI) ELSE 0 END AS name_length FROM client_hello",
)
def sni_guard(spark, sf):
    return clients(spark, sf).select("flow_id", columns.sni_guard(F.col("SNI"), F.length("SNI")).alias("name_length"))


@FLOWS.add(
    "align_zero_fill",
    with_views("server_hello")
    + """ SELECT flow_id, CAST(0 AS DOUBLE) AS otx_age, coalesce(TRY_CAST(SupportedVersion AS DOUBLE), 0) AS svr_supported_ver,
      CAST(0 AS DOUBLE) AS cs_002f, CAST(0 AS INTEGER) AS malware_label FROM server_hello""",
)
def align_zero_fill(spark, sf):
    have = servers(spark, sf).select("flow_id", F.col("SupportedVersion").try_cast("double").alias("svr_supported_ver"))
    return encode.align_zero_fill(have, ["otx_age", "svr_supported_ver", "cs_002f", "malware_label"], keep=["flow_id"])


@FLOWS.add("label_constant", with_views("client_hello") + " SELECT flow_id, 1 AS capture_label FROM client_hello")
def label_constant(spark, sf):
    return columns.with_label(clients(spark, sf).select("flow_id"), 1, "capture_label")


# --- pairing ---------------------------------------------------------------------------------------
@FLOWS.add("pair_first_match", WITH_PAIRED + f" SELECT flow_id, {KEYS}, srv_flow_id, srv_CipherSuite FROM paired")
def pair_first_match(spark, sf):
    return paired(spark, sf).select("flow_id", *S.ENDPOINT_KEYS, "srv_flow_id", "srv_CipherSuite")


@FLOWS.add(
    "pair_one_to_one",
    with_views("client_hello", "server_hello")
    + f""", c AS (SELECT flow_id, {KEYS}, row_number() OVER (PARTITION BY {KEYS} ORDER BY flow_id) AS pair_rank FROM client_hello),
      s AS (SELECT flow_id, {KEYS}, row_number() OVER (PARTITION BY {KEYS} ORDER BY flow_id) AS pair_rank FROM server_hello)
      SELECT c.flow_id, s.flow_id AS srv_flow_id, c.pair_rank FROM c JOIN s ON {MATCH} AND s.pair_rank = c.pair_rank""",
)
def pair_one_to_one(spark, sf):
    pairs = pairing.pair_one_to_one(clients(spark, sf), servers(spark, sf))
    return pairs.select("flow_id", "srv_flow_id", "pair_rank")


@FLOWS.add(
    "unpaired_clients",
    with_views("client_hello", "server_hello")
    + f" SELECT c.flow_id, c.SrcIP, c.DstIP FROM client_hello c WHERE NOT EXISTS (SELECT 1 FROM server_hello s WHERE {MATCH})",
)
def unpaired_clients(spark, sf):
    return pairing.unpaired_clients(clients(spark, sf), servers(spark, sf)).select("flow_id", "SrcIP", "DstIP")


TIMED = "SELECT e.*, ts FROM ({view}) e JOIN events v ON v.event_id = e.flow_id"
DAYS = f"""{with_views("client_hello", "server_hello")}, c AS ({TIMED.format(view="SELECT * FROM client_hello")}), s AS ({TIMED.format(view="SELECT * FROM server_hello")})"""


def _captures(spark, sf, closed):
    """Client and server records with their times, (name, rows) for both sides of each arrival: two halves and, if ``closed``,
    records weeks later that close the last day."""
    events = table(spark, sf, "events")
    middle, last = events.agg(F.expr("percentile_approx(event_id, 0.5)"), F.max("ts").cast("timestamp")).first()
    arrivals = [[] for _ in range(4 if closed else 2)]
    for name in ("client_hello", "server_hello"):
        times = events.select(F.col("event_id").alias("flow_id"), F.col("ts").cast("timestamp").alias("ts"))
        rows = materialized(view(spark, sf, name).join(times, "flow_id"), name)
        parts = [rows.where(F.col("flow_id") <= middle), rows.where(F.col("flow_id") > middle)]
        for weeks in (1, 2) if closed else ():
            late = {"ts": F.lit(last + dt.timedelta(weeks=weeks)), "SrcIP": F.lit("closing"), "DstIP": F.lit(name)}
            parts.append(rows.limit(1).withColumns(late))
        for arrival, part in zip(arrivals, parts, strict=True):
            arrival.append((name, part))
    return arrivals


def _arriving(spark, arrivals, path, run):
    """Each arrival is written by as many tasks as its rows have and is then one micro-batch of ``run``, which gets both streams."""
    for arrival in arrivals:
        for name, part in arrival:
            part.write.mode("append").parquet(f"{path}/{name}")
        run(*[spark.readStream.schema(part.schema).parquet(f"{path}/{name}") for name, part in arrival])


@FLOWS.add(
    "pair_first_stream",
    DAYS
    + f""", f AS (SELECT *, row_number() OVER (PARTITION BY {KEYS}, date_trunc('day', ts) ORDER BY flow_id) AS rn FROM s)
  SELECT c.flow_id, {", ".join(f"c.{k}" for k in S.ENDPOINT_KEYS)}, s.flow_id AS srv_flow_id FROM c JOIN f AS s ON {MATCH}
    AND date_trunc('day', c.ts) = date_trunc('day', s.ts) AND s.rn = 1""",
)
def pair_first_stream(spark, sf):
    """Each client with the first server of its 4-tuple and day, from two streams."""
    path = scratch_path(spark, "streams")

    def run(client_stream, server_stream):
        narrow = ["flow_id", *S.ENDPOINT_KEYS, "ts"]
        found = streaming.first_match(client_stream.select(*narrow), server_stream.select(*narrow))
        streaming.run_available(found.select("flow_id", *S.ENDPOINT_KEYS, "srv_flow_id"), f"{path}/progress", f"{path}/pairs")

    _arriving(spark, _captures(spark, sf, closed=True), path, run)
    return spark.read.parquet(f"{path}/pairs")


@FLOWS.add(
    "pair_one_to_one_stream",
    with_views("client_hello", "server_hello")
    + f""", c AS (SELECT flow_id, {KEYS}, row_number() OVER (PARTITION BY {KEYS} ORDER BY flow_id) AS pair_rank FROM client_hello),
      s AS (SELECT flow_id, {KEYS}, row_number() OVER (PARTITION BY {KEYS} ORDER BY flow_id) AS pair_rank FROM server_hello)
      SELECT c.flow_id, s.flow_id AS srv_flow_id, c.pair_rank FROM c JOIN s ON {MATCH} AND c.pair_rank = s.pair_rank""",
)
def pair_one_to_one_stream(spark, sf):
    """The k-th client with the k-th server, from two streams that arrive half by half."""
    path = scratch_path(spark, "streams")
    arrivals = _captures(spark, sf, closed=False)
    work, pairs = streaming.one_to_one(spark, f"{path}/state", *[part.schema for _, part in arrivals[0]])
    _arriving(spark, arrivals, path, lambda *streams: streaming.run_available(streaming.sides(*streams), f"{path}/progress", work))
    return pairs().select("flow_id", "srv_flow_id", "pair_rank")


# --- enrichment ------------------------------------------------------------------------------------
JA3_SQL = """ja3_first AS (SELECT ja3, min(first_seen) AS first_seen, min(last_seen) AS last_seen FROM blacklist GROUP BY ja3),
  ja3_hit AS (SELECT c.flow_id, CASE WHEN b.ja3 IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS ja3_urlhaus_status,
    coalesce(trunc((epoch(CAST(b.last_seen AS TIMESTAMP)) - epoch(CAST(b.first_seen AS TIMESTAMP))) / 86400), 0)::DOUBLE AS ja3_urlhaus_age
  FROM client_hello c LEFT JOIN ja3_first b ON b.ja3 = c.Ja3)"""
OTX_SQL = f"""otx_first AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY report_id) AS rn FROM otx_raw) WHERE rn = 1),
  otx_parsed AS (SELECT ip, json_array_length(general, '$.pulse_info.pulses') > 0 AS listed,
    json_extract_string(passive_dns, '$.passive_dns[0].last') AS newest,
    json_extract_string(passive_dns, '$.passive_dns[#-1].first') AS oldest FROM otx_first),
  otx_hit AS (SELECT c.flow_id, CASE WHEN c.DstIP LIKE '192.168.%' THEN 0.0 WHEN o.listed THEN 1.0 ELSE 0.0 END::DOUBLE AS otx_status,
    CASE WHEN c.DstIP LIKE '192.168.%' THEN 0 WHEN o.listed THEN
      coalesce(trunc((epoch(CAST(o.newest AS TIMESTAMP)) - epoch(CAST(o.oldest AS TIMESTAMP))) / 86400), 0) ELSE 0 END::DOUBLE AS otx_age
  FROM client_hello c LEFT JOIN otx_parsed o ON o.ip = c.DstIP)"""
URLHAUS_SQL = """uh_doc AS (SELECT report_id, json_extract_string(doc, '$.host') AS host, doc FROM urlhaus_raw),
  uh_first AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY report_id) AS rn FROM uh_doc) WHERE rn = 1),
  uh AS (SELECT host, CASE WHEN json_extract_string(doc, '$.urls[0].url_status') = 'online' THEN 1.0 ELSE 0.5 END::DOUBLE AS status,
    CASE WHEN json_extract_string(doc, '$.urls[0].url_status') = 'online' THEN trunc((epoch(TIMESTAMP '2024-01-31 00:00:00')
      - epoch(strptime(json_extract_string(doc, '$.firstseen'), '%Y-%m-%d %H:%M:%S UTC'))) / 86400) ELSE 0 END::DOUBLE AS age
    FROM uh_first WHERE json_extract_string(doc, '$.query_status') <> 'no_results'),
  uh_hit AS (SELECT c.flow_id, coalesce(n.status, a.status, 0)::DOUBLE AS urlhaus_status, coalesce(n.age, a.age, 0)::DOUBLE AS urlhaus_age
    FROM client_hello c LEFT JOIN uh n ON n.host = c.SNI
    LEFT JOIN uh a ON a.host = c.DstIP AND c.DstIP NOT LIKE '192.168.%')"""
POPULARITY_SQL = """pop AS (SELECT domain, count(DISTINCT list_date) / 15.0 AS score FROM popularity
    WHERE list_date BETWEEN DATE '2024-01-16' AND DATE '2024-01-29' AND rank <= 1000000 GROUP BY domain),
  pop_hit AS (SELECT c.flow_id, CASE WHEN c.SNI = '' THEN 0 ELSE coalesce(p.score, 0) END::DOUBLE AS dom_in_tranco_1m
    FROM client_hello c LEFT JOIN pop p ON p.domain = c.SNI)"""
DGA_SQL = """dga_hit AS (SELECT c.flow_id, CASE WHEN c.SNI = '' THEN 0 ELSE coalesce(d.prob, 0) END::DOUBLE AS dom_dga_prob
    FROM client_hello c LEFT JOIN dga d ON d.domain = c.SNI)"""
OSINT_HITS = "otx_hit JOIN uh_hit USING (flow_id) JOIN pop_hit USING (flow_id) JOIN dga_hit USING (flow_id)"


@FLOWS.add("ja3_lookup", with_views("client_hello", "blacklist") + f", {JA3_SQL} SELECT * FROM ja3_hit")
def ja3_lookup(spark, sf):
    flows = clients(spark, sf).select("flow_id", "Ja3")
    return enrich.ja3_lookup(flows, view(spark, sf, "blacklist")).drop("Ja3")


@FLOWS.add("otx_lookup", with_views("client_hello", "otx_raw") + f", {OTX_SQL} SELECT * FROM otx_hit")
def otx_lookup(spark, sf):
    flows = clients(spark, sf).select("flow_id", "DstIP")
    return enrich.otx_lookup(flows, fx.otx_reports(spark, sf), "report_id").drop("DstIP")


@FLOWS.add("urlhaus_lookup", with_views("client_hello", "urlhaus_raw") + f", {URLHAUS_SQL} SELECT * FROM uh_hit")
def urlhaus_lookup(spark, sf):
    flows = clients(spark, sf).select("flow_id", "DstIP", "SNI")
    return enrich.urlhaus_lookup(flows, fx.urlhaus_reports(spark, sf), "report_id", fx.AS_OF).drop("DstIP", "SNI")


POPULARITY_QUERY = (
    with_views("client_hello", "popularity") + f", {POPULARITY_SQL} SELECT flow_id, round(dom_in_tranco_1m, 6) AS dom_in_tranco_1m FROM pop_hit"
)


@FLOWS.add("domain_popularity", POPULARITY_QUERY)
def domain_popularity(spark, sf):
    flows = clients(spark, sf).select("flow_id", "SNI")
    scored = enrich.domain_popularity(flows, view(spark, sf, "popularity"), fx.AS_OF.date())
    return scored.select("flow_id", F.round("dom_in_tranco_1m", 6).alias("dom_in_tranco_1m"))


@FLOWS.add("domain_popularity_bucketed", POPULARITY_QUERY)
def domain_popularity_bucketed(spark, sf):
    """The same from a table that is bucketed by domain, of which only the window's dates are read."""
    path = scratch_path(spark, "popularity")
    name = f"popularity_{uuid.uuid4().hex}"
    intel.write_popularity_table(view(spark, sf, "popularity"), name, path, buckets=16)
    try:
        as_of = fx.AS_OF.date()
        lists = intel.read_popularity_table(spark, name, as_of - dt.timedelta(enrich.POPULARITY_DAYS), as_of, enrich.TOP_DOMAINS)
        scored = enrich.domain_popularity(clients(spark, sf).select("flow_id", "SNI"), lists, as_of)
        return materialized(scored.select("flow_id", F.round("dom_in_tranco_1m", 6).alias("dom_in_tranco_1m")), "scored")
    finally:
        spark.sql(f"DROP TABLE {name}")


@FLOWS.add(
    "dga_score", with_views("client_hello", "dga") + f", {DGA_SQL} SELECT flow_id, round(dom_dga_prob, 6) AS dom_dga_prob FROM dga_hit"
)
def dga_score(spark, sf):
    scored = enrich.dga_score(clients(spark, sf).select("flow_id", "SNI"), view(spark, sf, "dga"))
    return scored.select("flow_id", F.round("dom_dga_prob", 6).alias("dom_dga_prob"))


@FLOWS.add("dga_model")
def dga_model(spark, sf):
    """Name score from a model instead of a table: character 3-grams of page hosts, told apart by top-level domain."""
    host = F.regexp_extract("url", r"^https?://([^/:]+)", 1)
    pages = table(spark, sf, "pages").select("page_id", host.alias("host"))
    named = pages.select(
        "page_id", F.regexp_extract("host", r"^(.*)\.[^.]+$", 1).alias("name"), (~F.col("host").endswith(".com")).cast("double").alias("label")
    ).where("name != ''")
    stages = [
        RegexTokenizer(inputCol="name", outputCol="letters", pattern=".", gaps=False),
        NGram(n=3, inputCol="letters", outputCol="grams"),
        HashingTF(inputCol="grams", outputCol="features", numFeatures=1 << 14),
        LogisticRegression(regParam=0.01, maxIter=50),
    ]
    scored = Pipeline(stages=stages).fit(named).transform(named)
    return scored.select("page_id", vector_to_array("probability")[1].alias("prob"))


# names of page hosts, learned from half of them: those under a country's domain against the others
HOSTS = "SELECT DISTINCT regexp_extract(url, '^https?://([^/:]+)', 1) AS domain FROM pages"
NAMES_SQL = f"""WITH h AS (SELECT domain, CASE WHEN ends_with(domain, '.com') THEN 0 ELSE 1 END AS label, md5(domain) >= '8' AS held_out,
    concat('^', lower(split_part(domain, '.', 1)), '$') AS text FROM ({HOSTS}) WHERE domain <> ''),
  e AS (SELECT domain, label, held_out, text, unnest(range(1, length(text) + 1)) AS place FROM h),
  g AS (SELECT domain, label, held_out, place, n, substr(text, CAST(place - n + 1 AS BIGINT), CAST(n AS BIGINT)) AS gram FROM e, range(1, 4) AS r(n) WHERE n <= place),
  c AS (SELECT gram, n, sum(label) AS one, sum(1 - label) AS zero FROM g WHERE NOT held_out GROUP BY gram, n),
  t AS (SELECT n, sum(one) AS ones, sum(zero) AS zeros, count(*) AS grams FROM c GROUP BY n),
  m AS (SELECT gram, ln((one + 1) / (ones + grams)) - ln((zero + 1) / (zeros + grams)) AS odds FROM c JOIN t USING (n) WHERE one + zero >= 5),
  l AS (SELECT domain, place, arg_max(odds, g.n) AS odds FROM g JOIN m USING (gram) GROUP BY domain, place),
  s AS (SELECT domain, sum(odds) AS odds FROM l GROUP BY domain),
  b AS (SELECT ln((sum(label) + 1) / (sum(1 - label) + 1)) AS bias FROM h WHERE NOT held_out),
  scored AS (SELECT h.domain, h.label, h.held_out, 1 / (1 + exp(-(coalesce(s.odds, 0) + bias))) AS prob FROM h LEFT JOIN s ON h.domain = s.domain, b)"""


def _scored_hosts(spark, sf):
    host = F.regexp_extract("url", r"^https?://([^/:]+)", 1).alias("domain")
    hosts = table(spark, sf, "pages").select(host).where("domain <> ''").distinct()
    label = F.when(F.col("domain").endswith(".com"), 0).otherwise(1).alias("label")
    hosts = materialized(hosts.select("domain", label, (F.md5("domain") >= "8").alias("held_out")), "hosts")
    model = materialized(names.learn_names(hosts.where("not held_out")), "names")
    return hosts.join(names.score_names(hosts, model), "domain")


@FLOWS.add("name_model", NAMES_SQL + " SELECT domain, label, held_out, round(prob, 6) AS prob FROM scored")
def name_model(spark, sf):
    """Name scores by character n-grams with back-off, learned from half of the page hosts."""
    return _scored_hosts(spark, sf).select("domain", "label", "held_out", F.round("prob", 6).alias("prob"))


@FLOWS.add(
    "name_model_auc",
    NAMES_SQL
    + """, r AS (SELECT label, round(prob, 9) AS prob FROM scored WHERE held_out),
  p AS (SELECT sum(CASE WHEN a.prob > b.prob THEN 1.0 WHEN a.prob = b.prob THEN 0.5 ELSE 0.0 END) AS wins, count(*) AS n FROM r AS a, r AS b WHERE a.label = 1 AND b.label = 0)
  SELECT round(wins / n, 4) AS auc FROM p""",
)
def name_model_auc(spark, sf):
    """How well the scores tell the held-out hosts apart."""
    held = _scored_hosts(spark, sf).where("held_out").withColumn("prob", F.round("prob", 9))
    return evaluate.roc_auc(held, "prob", "label").select(F.round("auc", 4).alias("auc"))


ENRICH_SQL = (
    with_views("client_hello", "otx_raw", "urlhaus_raw", "popularity", "dga")
    + f", {OTX_SQL}, {URLHAUS_SQL}, {POPULARITY_SQL}, {DGA_SQL} SELECT flow_id, otx_status, otx_age, urlhaus_status, urlhaus_age, "
    f"round(dom_in_tranco_1m, 6) AS dom_in_tranco_1m, round(dom_dga_prob, 6) AS dom_dga_prob FROM {OSINT_HITS}"
)


@FLOWS.add(
    "enrich_distinct",
    ENRICH_SQL,
)
def enrich_distinct(spark, sf):
    flows = clients(spark, sf).select("flow_id", "DstIP", "SNI")
    i = fx.intelligence(spark, sf)
    known = enrich.enrich_distinct(flows, i.otx, i.urlhaus, i.popularity, i.dga, i.as_of, i.report_order)
    return known.select(
        "flow_id", "otx_status", "otx_age", "urlhaus_status", "urlhaus_age",
        F.round("dom_in_tranco_1m", 6).alias("dom_in_tranco_1m"), F.round("dom_dga_prob", 6).alias("dom_dga_prob"),
    )


@FLOWS.add("enrich_batches", ENRICH_SQL)
def enrich_batches(spark, sf):
    """Two batches of flows, the first of them run twice: each endpoint is looked up once for all."""
    flows = clients(spark, sf).select("flow_id", "DstIP", "SNI")
    middle = flows.agg(F.expr("percentile_approx(flow_id, 0.5)")).first()[0]
    parts = {"one": flows.where(F.col("flow_id") <= middle), "two": flows.where(F.col("flow_id") > middle)}
    i, folder = fx.intelligence(spark, sf), scratch_path(spark, "answers")
    done = {name: incremental.enrich_batch(parts[name], i, folder, "2024-01-31", name) for name in ("one", "one", "two")}
    return done["one"].unionByName(done["two"]).select(
        "flow_id", "otx_status", "otx_age", "urlhaus_status", "urlhaus_age",
        F.round("dom_in_tranco_1m", 6).alias("dom_in_tranco_1m"), F.round("dom_dga_prob", 6).alias("dom_dga_prob"),
    )


# --- code weights ----------------------------------------------------------------------------------
def _known(ranges) -> str:
    return "(" + " OR ".join(f"code BETWEEN {low} AND {high}" for low, high in ranges) + ")"


def _tokens(column: str, chosen: str = "NULL") -> str:
    return f"""(SELECT flow_id, malware_label, chosen, TRY_CAST(t AS INTEGER) AS code FROM (SELECT flow_id, malware_label,
      TRY_CAST({chosen} AS INTEGER) AS chosen, unnest(string_split(CASE WHEN starts_with({column}, '(')
      THEN substr({column}, 2, length({column}) - 2) ELSE {column} END, '-')) AS t FROM paired)
      WHERE TRY_CAST(t AS INTEGER) IS NOT NULL)"""


CELLS_SQL = {
    "cipher": f"""SELECT flow_id, malware_label, CASE WHEN {_known(S.CIPHER_RANGES)} THEN concat('cs_', printf('%04x', code)) ELSE 'cs_unknown' END AS feature,
      sum(CASE WHEN code = chosen THEN 1.0 ELSE 0.5 END)::DOUBLE AS value FROM {_tokens("CipherSuites", "srv_CipherSuite")} GROUP BY ALL""",
    "signature": f"""SELECT flow_id, malware_label, concat('sig_', printf('%04x', code)) AS feature, 0.5::DOUBLE AS value
      FROM {_tokens("SignatureAlgs")} WHERE {_known(S.SIGNATURE_MATCHED_RANGES)} GROUP BY ALL
      UNION ALL SELECT flow_id, malware_label, 'sig_grease', (1 + 0.5 * (count(*) - 1))::DOUBLE FROM {_tokens("SignatureAlgs")}
        WHERE code <> 0 AND NOT {_known(S.SIGNATURE_MATCHED_RANGES)} GROUP BY ALL
      UNION ALL SELECT flow_id, malware_label, 'sig_empty', 0.5::DOUBLE FROM paired WHERE SignatureAlgs = '()'""",
    "group": f"""SELECT flow_id, malware_label, concat('grp_', printf('%02d', code)) AS feature,
      (CASE WHEN code = chosen THEN 1.0 ELSE 0.5 END)::DOUBLE AS value FROM {_tokens("SupportedGroups", "srv_SelectedGroup")}
        WHERE {_known(S.GROUP_RANGES)} GROUP BY ALL
      UNION ALL SELECT flow_id, malware_label, 'grp_grease', sum(CASE WHEN code = chosen THEN 1.0 ELSE 0.5 END)::DOUBLE
        FROM {_tokens("SupportedGroups", "srv_SelectedGroup")} WHERE NOT {_known(S.GROUP_RANGES)} GROUP BY ALL""",
    "point": f"""SELECT flow_id, malware_label, concat('pts_', printf('%02d', code)) AS feature, 0.5::DOUBLE AS value
      FROM {_tokens("SupportedPoints")} WHERE {_known(S.POINT_RANGES)} GROUP BY ALL""",
    "extension": f"""SELECT flow_id, malware_label, concat('svr_ext_', printf('%02d', code)) AS feature, 0.5::DOUBLE AS value
      FROM {_tokens("srv_Extensions")} WHERE {_known(S.EXTENSION_RANGES)} GROUP BY ALL
      UNION ALL SELECT flow_id, malware_label, 'svr_ext_unassigned', (0.5 * count(*))::DOUBLE FROM {_tokens("srv_Extensions")}
        WHERE NOT {_known(S.EXTENSION_RANGES)} GROUP BY ALL""",
}
def _register_family(family: str) -> None:
    sql = WITH_PAIRED + f" SELECT flow_id, feature, value FROM ({CELLS_SQL[family]})"

    @FLOWS.add(f"{family}_weights", sql)
    def weights(spark, sf):
        return encode.encode_sparse(encode.weigh_codes(paired(spark, sf), [family]), ["flow_id"])


for _family in CELLS_SQL:
    _register_family(_family)

SCALAR_CELLS = " UNION ALL ".join(
    [f"SELECT flow_id, malware_label, '{name}' AS feature, CAST({field} AS DOUBLE) AS value FROM paired" for name, field in S.CLIENT_SCALARS.items()]
    + [
        "SELECT flow_id, malware_label, 'svr_tls_ver', CAST(srv_Version AS DOUBLE) FROM paired",
        "SELECT flow_id, malware_label, 'svr_supported_ver', CAST(srv_SupportedVersion AS DOUBLE) FROM paired",
        "SELECT flow_id, malware_label, 'svr_ocsp_staple', CASE WHEN srv_OCSPStapling = 'false' THEN 0.0 ELSE 1.0 END FROM paired",
    ]
)
ALL_CELLS = "cells AS (" + " UNION ALL ".join(f"(SELECT * FROM ({part}))" for part in [*CELLS_SQL.values(), SCALAR_CELLS]) + ")"


@FLOWS.add(
    "encode_sparse", WITH_PAIRED + f", {ALL_CELLS} SELECT flow_id, feature, round(value, 6) AS value FROM cells WHERE value <> 0"
)
def encode_sparse(spark, sf):
    weighed = encode.with_scalars(encode.weigh_codes(paired(spark, sf)).drop("malware_label"))
    cells = encode.encode_sparse(weighed, keep=["flow_id"])
    return cells.withColumn("value", F.round("value", 6))


NAMES_SQL = "names AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in S.FEATURE_COLUMNS if c != S.LABEL) + "]) AS feature)"
OSINT_CELLS = " UNION ALL ".join(
    f"SELECT p.flow_id, p.malware_label, '{name}', h.{name} FROM paired p JOIN {hit} h USING (flow_id)"
    for hit, names in {
        "pop_hit": ["dom_in_tranco_1m"],
        "dga_hit": ["dom_dga_prob"],
        "otx_hit": ["otx_status", "otx_age"],
        "uh_hit": ["urlhaus_status", "urlhaus_age"],
        "ja3_hit": ["ja3_urlhaus_status", "ja3_urlhaus_age"],
    }.items()
    for name in names
)


@FLOWS.add(
    "extract_features",
    with_views("client_hello", "server_hello", "blacklist", "otx_raw", "urlhaus_raw", "popularity", "dga")
    + f", {PAIRED}, {JA3_SQL}, {OTX_SQL}, {URLHAUS_SQL}, {POPULARITY_SQL}, {DGA_SQL}, {ALL_CELLS}, {NAMES_SQL}, "
    f"everything AS (SELECT * FROM cells UNION ALL ({OSINT_CELLS})) "
    "SELECT n.feature, round(coalesce(sum(e.value) FILTER (WHERE e.malware_label = 0), 0), 4) AS benign, "
    "round(coalesce(sum(e.value) FILTER (WHERE e.malware_label = 1), 0), 4) AS malware "
    "FROM names n LEFT JOIN everything e USING (feature) GROUP BY n.feature",
)
def extract_features(spark, sf):
    """The whole job from hello records to features, summed per column and class."""
    flows = extract.extract_flows(clients(spark, sf), servers(spark, sf), fx.intelligence(spark, sf), F.col("malware_label"))
    vectors = encode.encode_vector(flows, keep=["malware_label"])
    sums = class_measures(summarize_vector(vectors, "features", encode.VECTOR_COLUMNS, ["malware_label"]), "total")
    return sums.select("feature", F.round("benign", 4).alias("benign"), F.round("malware", 4).alias("malware"))


@FLOWS.add("feature_file_parquet", FEATURE_FILE_SQL)
def feature_file_parquet(spark, sf):
    return _feature_file(spark, sf, "parquet")


@FLOWS.add("feature_file_batches", FEATURE_FILE_SQL)
def feature_file_batches(spark, sf):
    """One batch per class; the first is run again after it finished, which adds nothing."""
    path, weighed = scratch_path(spark, "features"), _weighed(spark, sf)
    for value in (0, 1, 0):
        tables.append_features(encode.encode_wide(encode.dealt(weighed.where(F.col("malware_label") == value))), path, f"class {value}")
    return _class_sums(tables.read_feature_batches(spark, path))


@FLOWS.add("feature_file_csv", FEATURE_FILE_SQL)
def feature_file_csv(spark, sf):
    return _feature_file(spark, sf, "csv")


@FLOWS.add(
    "blacklisted_by_class",
    with_views("client_hello", "server_hello", "blacklist")
    + f", {PAIRED}, {JA3_SQL} SELECT malware_label, count(*) AS flows, count(*) FILTER (WHERE ja3_urlhaus_status = 1) AS blacklisted "
    "FROM paired JOIN ja3_hit USING (flow_id) GROUP BY malware_label",
)
def blacklisted_by_class(spark, sf):
    return extract.blacklisted_by_class(clients(spark, sf), servers(spark, sf), view(spark, sf, "blacklist"))
