"""Pairing while records arrive gives the pairs of the batch operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowscope.operators import pairing
from flowscope.streaming import pairing as streaming

START = dt.datetime(2024, 1, 1)
FIELDS = "flow_id bigint, SrcIP string, SrcPort string, DstIP string, DstPort string, ts timestamp, note string"


def records(spark, rows, turned):
    """Rows of (id, key, hours)."""
    one, two = ("srv", "443"), ("cli", "9")
    ends = lambda key: (*(one if turned else two), *(two if turned else one))
    out = []
    for ident, key, hours in rows:
        a, b, c, d = ends(key)
        out.append((ident, f"{a}{key}", b, f"{c}{key}", d, START + dt.timedelta(hours=hours), f"n{ident}"))
    return spark.createDataFrame(out, FIELDS)


def arrivals(spark, folder, parts, turned):
    for part in parts:
        records(spark, part, turned).repartition(1).write.mode("append").parquet(folder)
    schema = records(spark, [], turned).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


# the hot key 0 and others; the second file holds servers with smaller ids, and one client has no server on its day
CLIENTS = [[(i, i % 4 if i % 2 else 0, i % 20) for i in range(40)], [(100 + i, i % 5, 24 + i % 20) for i in range(30)]]
SERVERS = [[(50 + i, i % 3, i % 20) for i in range(20)], [(i, i % 3, 10 + i) for i in range(8)] + [(200 + i, i % 4, 25) for i in range(9)]]
CLOSING = [[(900, 99, 24 * 9)], [(901, 99, 24 * 19)]]


def pairs_of(df):
    return sorted((r.flow_id, r.srv_flow_id, r.srv_note) for r in df.where("flow_id not in (900, 901)").collect())


def test_first_match(spark, tmp_path):
    clients = arrivals(spark, f"{tmp_path}/c", CLIENTS + CLOSING, False)
    servers = arrivals(spark, f"{tmp_path}/s", SERVERS + CLOSING, True)
    streaming.run_available(streaming.first_match(clients, servers, salts=3, delay="2 days"), f"{tmp_path}/progress", f"{tmp_path}/out")
    want = []
    for day in (0, 1):
        on = lambda rows: [r for part in rows for r in part if r[2] // 24 == day]  # noqa: E731, B023
        want += pairs_of(pairing.pair_first_match(records(spark, on(CLIENTS), False), records(spark, on(SERVERS), True)))
    got = pairs_of(spark.read.parquet(f"{tmp_path}/out"))
    assert got == sorted(want) and 0 < len(got) < 70


def test_first_match_drops_late_records_and_keeps_duplicates(spark, tmp_path):
    # a micro-batch takes rows as late by the watermark of the one before the last
    late = [[(1, 0, 1), (1, 0, 1)], [(5, 7, 24 * 9)], [(6, 8, 24 * 9)], [(2, 0, 2)], *CLOSING]
    servers = [[(10, 0, 1), (10, 0, 1)], [(11, 7, 24 * 9)], [(12, 9, 24 * 9)], [(3, 0, 2)], *CLOSING]
    out = streaming.first_match(arrivals(spark, f"{tmp_path}/c", late, False), arrivals(spark, f"{tmp_path}/s", servers, True))
    streaming.run_available(out, f"{tmp_path}/progress", f"{tmp_path}/out")
    assert pairs_of(spark.read.parquet(f"{tmp_path}/out")) == [(1, 10, "n10"), (1, 10, "n10"), (5, 11, "n11")]


def test_one_to_one(spark, tmp_path):
    in_order = lambda parts: [sorted(parts[0]), sorted((r[0] + 1000, *r[1:]) for r in parts[1])]
    clients, servers = in_order(CLIENTS), in_order(SERVERS)
    streams = [arrivals(spark, f"{tmp_path}/c", clients, False), arrivals(spark, f"{tmp_path}/s", servers, True)]
    work, pairs = streaming.one_to_one(spark, f"{tmp_path}/state", streams[0].schema, streams[1].schema)
    failed = []

    def twice(rows, batch):  # the second micro-batch fails after its work is done, and is run again
        work(rows, batch)
        if batch == 1 and not failed:
            failed.append(batch)
            raise RuntimeError("lost")

    both = streaming.sides(*streams)
    with pytest.raises(Exception, match="lost"):
        streaming.run_available(both, f"{tmp_path}/progress", twice)
    streaming.run_available(both, f"{tmp_path}/progress", twice)
    flat = lambda parts: [r for part in parts for r in part]
    want = pairing.pair_one_to_one(records(spark, flat(clients), False), records(spark, flat(servers), True))
    got = pairs()
    assert failed == [1] and pairs_of(got) == pairs_of(want) and got.select("pair_rank").agg(F.max("pair_rank")).first()[0] > 5


def test_an_arrival_is_one_batch_of_many_files(spark, tmp_path):
    from flowscope.workload import flow_queries

    halves = [spark.range(a, a + 100, 1, 4).toDF("flow_id") for a in (0, 100)]
    arrivals, seen = [[("one", half), ("two", half)] for half in halves], []
    work = lambda rows, batch: seen.append((batch, rows.count(), rows.agg({"flow_id": "max"}).first()[0]))
    flow_queries._arriving(spark, arrivals, str(tmp_path / "in"), lambda one, two: streaming.run_available(one.union(two), str(tmp_path / "progress"), work))
    assert seen == [(0, 200, 99), (1, 200, 199)]
    assert len(list((tmp_path / "in" / "one").glob("*.parquet"))) == 8
