import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowscope.operators import enrich, pairing, skew
from flowscope.schema import ENDPOINT_KEYS, OTX_REPORT, URLHAUS_REPORT

AS_OF = dt.datetime(2024, 1, 31)


def hellos(spark, n, keys, hot, step):
    """n records over ``keys`` 4-tuples, a third of them on one tuple."""
    key = F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.col("id") * step % keys)
    return spark.range(n).select(F.col("id").alias("flow_id"), key.alias("k"))


def clients(spark):
    rows = hellos(spark, 3000, 40, 5, 7)
    return rows.select("flow_id", F.concat(F.lit("10.0.0."), "k").alias("SrcIP"), F.lit("4000").alias("SrcPort"),
                       F.lit("8.8.8.8").alias("DstIP"), F.lit("443").alias("DstPort"))


def servers(spark):
    rows = hellos(spark, 2400, 30, 5, 11)
    return rows.select("flow_id", F.lit("8.8.8.8").alias("SrcIP"), F.lit("443").alias("SrcPort"),
                       F.concat(F.lit("10.0.0."), "k").alias("DstIP"), F.lit("4000").alias("DstPort"),
                       F.col("flow_id").cast("string").alias("Version"))


@pytest.fixture(scope="module")
def truth(spark):
    by_ip = {}
    for row in servers(spark).orderBy("flow_id").collect():
        by_ip.setdefault(row.DstIP, []).append(row.flow_id)
    return [(r.flow_id, r.SrcIP) for r in clients(spark).orderBy("flow_id").collect()], by_ip


def test_first_match(spark, truth):
    flows, by_ip = truth
    got = {r.flow_id: r.srv_flow_id for r in pairing.pair_first_match(clients(spark), servers(spark)).collect()}
    assert got == {i: by_ip[ip][0] for i, ip in flows if ip in by_ip}


def test_one_to_one(spark, truth):
    flows, by_ip = truth
    expected, used = {}, {}
    for i, ip in flows:
        place = used[ip] = used.get(ip, -1) + 1
        if place < len(by_ip.get(ip, [])):
            expected[i] = by_ip[ip][place]
    rows = pairing.pair_one_to_one(clients(spark), servers(spark)).collect()
    assert {r.flow_id: r.srv_flow_id for r in rows} == expected
    assert len({r.srv_flow_id for r in rows}) == len(rows)


def test_unpaired(spark, truth):
    flows, by_ip = truth
    got = {r.flow_id for r in pairing.unpaired_clients(clients(spark), servers(spark)).collect()}
    assert got == {i for i, ip in flows if ip not in by_ip}


def test_hot_keys_are_found_and_spread(spark):
    df = clients(spark)
    hot = df.select(skew.hot_keys(df, ENDPOINT_KEYS).alias("hot")).first().hot
    assert len(hot) >= 1
    salted = skew.salted_join(df, df.select("SrcIP").distinct().withColumn("v", F.lit(1)), ["SrcIP"], ["flow_id"])
    assert salted.count() == 3000


def test_lookup_beyond_the_broadcast_limit(spark):
    df = clients(spark)
    table = df.select("SrcIP").distinct().where("SrcIP <> '10.0.0.5'").withColumn("v", F.length("SrcIP"))
    small = skew.attach(df, table, ["SrcIP"], ["flow_id"])
    large = skew.attach(df, table, ["SrcIP"], ["flow_id"], limit=0)
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, large.collect()), key=str)


def test_ja3(spark):
    listed = spark.createDataFrame(
        [("b386946a5a44d1ddcc843bc75336dfce", "2017-07-14 18:08:15", "2019-07-27 20:42:54", "Dridex"),
         ("aa", "2018-01-02 00:00:00", "2018-02-02 00:00:00", "x")], "ja3 string, first_seen string, last_seen string, reason string")
    flows = spark.createDataFrame([(1, "b386946a5a44d1ddcc843bc75336dfce"), (2, "aa"), (3, "none")], "flow_id int, Ja3 string")
    got = {r.flow_id: (r.ja3_urlhaus_status, r.ja3_urlhaus_age) for r in enrich.ja3_lookup(flows, listed).collect()}
    assert got == {1: (1.0, 743.0), 2: (1.0, 31.0), 3: (0.0, 0.0)}
    swapped = {r.flow_id: (r.ja3_urlhaus_status, r.ja3_urlhaus_age) for r in enrich.ja3_lookup(flows, listed, swapped_dates=True).collect()}
    assert swapped == {1: (0.0, 0.0), 2: (1.0, 1.0), 3: (0.0, 0.0)}


def test_otx(spark):
    dns = [{"first": "2021-01-01T00:00:00", "last": "2021-03-01T12:00:00"}, {"first": "2021-02-01T00:00:00", "last": "2021-02-02T00:00:00"}]
    rows = [
        ("8.8.8.8", {"pulse_info": {"pulses": [{"id": "a"}]}}, {"passive_dns": dns}),
        ("8.8.4.4", {"pulse_info": {"pulses": []}}, {"passive_dns": dns}),
        ("9.9.9.9", {"pulse_info": {"pulses": [{"id": "a"}]}}, {"passive_dns": []}),
        ("10.0.0.1", {"pulse_info": {"pulses": [{"id": "a"}]}}, {"passive_dns": dns}),
    ]
    reports = spark.createDataFrame(rows, OTX_REPORT).withColumn("report_id", F.lit(1))
    flows = spark.createDataFrame([(i, ip) for i, ip in enumerate(["8.8.8.8", "8.8.4.4", "9.9.9.9", "10.0.0.1", "7.7.7.7"])], "flow_id int, DstIP string")
    got = {r.flow_id: (r.otx_status, r.otx_age) for r in enrich.otx_lookup(flows, reports, "report_id").collect()}
    assert got == {0: (1.0, 28.0), 1: (0.0, 0.0), 2: (1.0, 0.0), 3: (0.0, 0.0), 4: (0.0, 0.0)}


def test_urlhaus(spark):
    seen = "2024-01-01 12:00:00 UTC"
    rows = [
        ("online.com", "ok", seen, [{"url_status": "online"}]),
        ("offline.com", "ok", seen, [{"url_status": "offline"}, {"url_status": "online"}]),
        ("nourls.com", "ok", seen, []),
        ("none.com", "no_results", None, None),
        ("8.8.8.8", "ok", seen, [{"url_status": "online"}]),
        ("10.0.0.1", "ok", seen, [{"url_status": "online"}]),
    ]
    reports = spark.createDataFrame(rows, URLHAUS_REPORT).withColumn("report_id", F.lit(1))
    flows = spark.createDataFrame(
        [(0, "online.com", "1.1.1.1"), (1, "offline.com", "8.8.8.8"), (2, "nourls.com", "8.8.8.8"), (3, "none.com", "8.8.8.8"),
         (4, "none.com", "10.0.0.1"), (5, "unlisted.com", "8.8.8.8"), (6, "", "1.1.1.1")], "flow_id int, SNI string, DstIP string")
    run = lambda **mode: {
        r.flow_id: (r.urlhaus_status, r.urlhaus_age) for r in enrich.urlhaus_lookup(flows, reports, "report_id", AS_OF, **mode).collect()
    }
    hit, half, miss = (1.0, 29.0), (0.5, 0.0), (0.0, 0.0)
    assert run() == {0: hit, 1: half, 2: half, 3: hit, 4: miss, 5: hit, 6: miss}
    assert run(address_fallback=False) == {0: hit, 1: half, 2: half, 3: miss, 4: miss, 5: miss, 6: miss}


def test_popularity_window(spark):
    days = [(AS_OF.date() - dt.timedelta(i), 1, "always.com") for i in range(0, 40)]
    days += [(AS_OF.date() - dt.timedelta(2), 9, "rare.com"), (AS_OF.date() - dt.timedelta(1), 1, "late.com")]
    lists = spark.createDataFrame(days, "list_date date, rank int, domain string")
    flows = spark.createDataFrame([(0, "always.com"), (1, "rare.com"), (2, "late.com"), (3, "")], "flow_id int, SNI string")
    got = {r.flow_id: r.dom_in_tranco_1m for r in enrich.domain_popularity(flows, lists, AS_OF.date()).collect()}
    assert got == {0: pytest.approx(14 / 15), 1: pytest.approx(1 / 15), 2: 0.0, 3: 0.0}
    top = {r.flow_id: r.dom_in_tranco_1m for r in enrich.domain_popularity(flows, lists, AS_OF.date(), top=5).collect()}
    assert top[1] == 0.0
