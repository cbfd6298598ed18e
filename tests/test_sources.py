"""Files with their own headers and order, and tables that grow by batches."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from flowscope import schema as S
from flowscope.operators import encode, enrich, pairing
from flowscope.plans import incremental
from flowscope.sources import batches, hello, intel, tables
from flowscope.workload import fixtures as fx

NAMES = S.SERVER_HELLO.fieldNames()


def server(n, **values):
    return {**dict.fromkeys(NAMES, ""), "SrcIP": "1.1.1.1", "SrcPort": "443", "DstIP": "2.2.2.2", "DstPort": "9", "CipherSuite": str(n), **values}


def write(path, rows, columns, blank_every=0):
    with open(path, "w", newline="") as file:
        file.write(",".join(columns) + "\r\n")
        for i, row in enumerate(rows):
            file.write(",".join(row.get(c, "x") for c in columns) + "\r\n")
            if blank_every and i % blank_every == 0:
                file.write("\r\n")


@pytest.fixture
def captures(tmp_path):
    """Three files: few rows, many rows under another column order, and a header alone."""
    folder = tmp_path / "servers"
    folder.mkdir()
    write(folder / "a.csv", [server(n) for n in range(3)], NAMES)
    write(folder / "b.csv", [server(3 + n, Extensions='"(0-23,""q"")"') for n in range(2000)], ["more", *reversed(NAMES)], blank_every=7)
    write(folder / "c.csv", [], NAMES)
    write(folder / "d.csv", [server(2003, SrcIP="3.3.3.3")], NAMES)
    return str(folder)


@pytest.mark.parametrize("split", ["1k", "128m"])
def test_order_and_headers_of_several_files(spark, captures, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = hello.read_server_hello(spark, captures).orderBy("flow_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.CipherSuite for r in rows] == [str(n) for n in range(2004)]
    assert rows[0].Extensions == "" and rows[3].Extensions == '(0-23,"q")' and rows[2003].SrcIP == "3.3.3.3"
    lines = [1, 2, 3]  # line numbers over all files: headers and blank lines count
    for n in range(2000):
        lines.append(5 + n + (n + 6) // 7)
    assert [r.flow_id for r in rows][:2003] == lines
    client = spark.createDataFrame([("2.2.2.2", "9", "1.1.1.1", "443", 1)], "SrcIP string, SrcPort string, DstIP string, DstPort string, flow_id bigint")
    pair = pairing.pair_first_match(client, hello.read_server_hello(spark, captures)).collect()
    assert [r.srv_CipherSuite for r in pair] == ["0"]


def test_header_without_a_needed_column(spark, tmp_path):
    write(tmp_path / "a.csv", [server(1)], NAMES[1:])
    with pytest.raises(ValueError, match=NAMES[0]):
        hello.read_server_hello(spark, str(tmp_path / "a.csv"))


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text("\n\n" + ",".join(NAMES) + "\n\n")
    found = hello.read_server_hello(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert found.columns == ["flow_id", *NAMES] and found.collect() == []


def test_batches_take_effect_once(spark, tmp_path):
    path, rows = f"{tmp_path}/table", spark.range(10).withColumn("x", F.col("id") * 2)
    read = lambda: sorted(r.id for r in batches.read_batches(spark, path, rows.schema).collect())
    assert read() == []
    assert batches.append_once(rows.where("id < 4"), path, "one") and read() == [0, 1, 2, 3]
    assert not batches.append_once(rows.where("id < 4"), path, "one") and read() == [0, 1, 2, 3]

    @F.udf("bigint")
    def fail(x):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        batches.append_once(rows.withColumn("x", fail("id")), path, "two")
    rows.write.parquet(f"{path}/data/attempt=abandoned")
    assert read() == [0, 1, 2, 3] and not batches.committed(spark, path, "two")
    assert batches.append_once(rows.where("id >= 4"), path, "two") and read() == list(range(10))


def test_bucketed_lists_are_not_exchanged(spark, tmp_path):
    days = [dt.date(2024, 1, d) for d in range(10, 31)]
    rows = [(day, r, f"d{(r * 7 + day.day) % 40}") for day in days for r in range(1, 21)]
    lists = spark.createDataFrame(rows, "list_date date, rank int, domain string")
    flows = spark.createDataFrame([(i, f"d{i}" if i < 45 else "") for i in range(50)], "flow_id bigint, SNI string")
    as_of = dt.date(2024, 1, 31)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        intel.write_popularity_table(lists, "popularity_test", f"file://{tmp_path}/lists", buckets=8)
        stored = intel.read_popularity_table(spark, "popularity_test", dt.date(2024, 1, 16), dt.date(2024, 1, 29), 20)
        found = enrich.popularity_table(flows, stored, as_of)
        want = sorted(map(tuple, enrich.popularity_table(flows, lists, as_of).collect()))
        assert sorted(map(tuple, found.collect())) == want and want
        plan = found._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0].splitlines()
        scan = next(i for i, line in enumerate(final) if "popularity_test" in line)
        depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
        above, level = [], depth(final[scan])
        for line in reversed(final[:scan]):  # the operators between the scan and the root
            if depth(line) < level:
                above.append(line)
                level = depth(line)
        assert any("SortMergeJoin" in line for line in above) and not any("Exchange" in line for line in above)
        assert "PartitionFilters: [isnotnull(list_date" in plan and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        spark.sql("DROP TABLE IF EXISTS popularity_test")


def test_two_writers_of_a_batch(spark, tmp_path, monkeypatch):
    path, rows = f"{tmp_path}/table", spark.range(5)
    real, calls = batches.committed, []

    def blind(*args):  # the first look of the second writer comes before the first one's commit
        calls.append(args)
        return False if len(calls) == 2 else real(*args)

    monkeypatch.setattr(batches, "committed", blind)
    assert batches.append_once(rows, path, "one")
    assert not batches.append_once(rows, path, "one")
    assert batches.read_batches(spark, path, rows.schema).count() == 5
    assert len([d for d in os.listdir(f"{path}/data") if d.startswith("attempt")]) == 2


def test_endpoints_are_looked_up_once(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no benchmark tables here")
    flows, known = fx.view(spark, folder, "client_hello").select("flow_id", "DstIP", "SNI"), fx.intelligence(spark, folder)
    flows = flows.unionByName(spark.createDataFrame([(-1, None, None), (-2, None, None)], "flow_id bigint, DstIP string, SNI string"))
    parts = [flows.where("flow_id % 3 = 0"), flows.where("flow_id % 3 <> 0")]
    keys = [{(r.DstIP, r.SNI) for r in p.collect()} for p in parts]
    seen = []
    for part, name in zip([parts[0], parts[0], parts[1]], ["one", "one", "two"], strict=True):
        table = incremental.look_up_batch(part, known, f"{tmp_path}/answers", "v1", name)
        seen.append(table.count())
    assert seen == [len(keys[0]), len(keys[0]), len(keys[0] | keys[1])]
    assert incremental.unseen_endpoints(flows, table).count() == 0
    fresh = incremental.look_up_batch(parts[1], known, f"{tmp_path}/answers", "v2", "two")  # another snapshot starts anew
    assert fresh.count() == len(keys[1])


def test_a_line_is_parsed_once(spark, tmp_path):
    names = S.CLIENT_HELLO.fieldNames()
    (tmp_path / "a.csv").write_text(",".join(names) + "\n" + ",".join(names) + "\n")
    rows = hello.read_client_hello(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("from_csv(") + plan.count("csvtostructs(") == 1
    assert rows.first().asDict() == {"flow_id": 1, **{n: n for n in names}}


def test_feature_csv_is_small(spark, tmp_path):
    rows = spark.range(0, 500, 1, 1).select((F.col("id") % 2).cast("int").alias(S.LABEL), F.col("id").cast("double").alias("message_len"))
    tables.write_features(encode.align_zero_fill(rows), str(tmp_path / "t"), "csv")
    assert sum(f.stat().st_size for f in (tmp_path / "t").glob("part-*")) < 500 * 519 // 10
    back = tables.read_features(spark, str(tmp_path / "t"), "csv")
    assert back.agg(F.count("*"), F.sum("message_len"), F.sum(S.LABEL)).first() == (500, 124750.0, 250)
