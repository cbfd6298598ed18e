import pytest
from pyspark.sql import functions as F

from flowscope import schema as S
from flowscope.operators import encode

BASE = {
    "flow_id": 1, "SrcPort": "40000", "DstPort": "443", "Type": "22", "Version": "769", "MessageLen": "517",
    "HandshakeType": "1", "HandshakeVersion": "771", "HandshakeLen": "513", "CipherSuiteLen": "8", "ExtensionLen": "100",
    "CipherSuites": "(47)", "SignatureAlgs": "(1027)", "SupportedGroups": "(29)", "SupportedPoints": "0",
    "srv_Version": "771", "srv_SupportedVersion": "772", "srv_OCSPStapling": "false", "srv_SelectedGroup": "24",
    "srv_CipherSuite": "53", "srv_Extensions": "(0-23)",
}


def flow(spark, **fields):
    row = {**BASE, **fields}
    return spark.createDataFrame([tuple(row.values())], list(row))


def values(spark, weigh=encode.weigh_codes, **fields):
    rows = encode.encode_sparse(weigh(flow(spark, **fields)), ["flow_id"]).collect()
    return {r.feature: r.value for r in rows}


def test_cipher_bonus_at_each_occurrence(spark):
    got = values(spark, CipherSuites="(47-47-2570)", srv_CipherSuite="47")
    assert got["cs_002f"] == 2.0 and got["cs_unknown"] == 0.5


def test_unknown_chosen_cipher(spark):
    fields = {"CipherSuites": "(47-2570-53)", "srv_CipherSuite": "2570"}
    fixed = values(spark, **fields)
    assert fixed["cs_unknown"] == 1.0 and fixed["cs_0035"] == 0.5 and fixed["grp_29"] == 0.5
    compat = values(spark, encode.weigh_codes_stop_at_error, **fields)
    assert compat == {"cs_002f": 0.5, "cs_unknown": 0.5}


@pytest.mark.parametrize("n,weight", [(1, 1.0), (2, 1.5), (4, 2.5)])
def test_reserved_signatures(spark, n, weight):
    got = values(spark, SignatureAlgs="(" + "-".join(["1027"] + ["2570"] * n) + ")")
    assert got["sig_grease"] == weight and got["sig_0403"] == 0.5


def test_empty_and_upper_case_signatures(spark):
    assert values(spark, SignatureAlgs="()")["sig_empty"] == 0.5
    got = values(spark, SignatureAlgs="(1802-0)")
    assert got["sig_grease"] == 1.0 and got["sig_empty"] == 0.5 and "sig_070a" not in got


def test_groups(spark):
    got = values(spark, SupportedGroups="(29-2570)", srv_SelectedGroup="29")
    assert got["grp_29"] == 1.0 and got["grp_grease"] == 0.5
    got = values(spark, SupportedGroups="(29-29-2570-2570)", srv_SelectedGroup="2570")
    assert got["grp_29"] == 0.5 and got["grp_grease"] == 2.0


def test_points(spark):
    got = values(spark, SupportedPoints="(0-1-9)")
    assert got["pts_00"] == got["pts_01"] == 0.5 and "pts_09" not in got
    assert values(spark, encode.weigh_codes_stop_at_error, SupportedPoints="(0-9)") == {}


def test_extensions(spark):
    got = values(spark, srv_Extensions="(0-54-54-65281)")
    assert got["svr_ext_00"] == got["svr_ext_65281"] == 0.5 and got["svr_ext_unassigned"] == 1.0
    assert values(spark, srv_Extensions="65281")["svr_ext_65281"] == 0.5
    assert values(spark, encode.weigh_codes_stop_at_error, srv_Extensions="65281")["svr_ext_unassigned"] == 0.5
    assert not any(name.startswith("svr_ext") for name in values(spark, srv_Extensions=""))


@pytest.mark.parametrize(
    "fields,present,absent",
    [
        ({"CipherSuites": "()"}, [], ["cs_", "sig_", "grp_", "pts_", "svr_ext_"]),
        ({"SignatureAlgs": "()"}, ["cs_002f", "sig_empty", "grp_29"], []),
        ({"SupportedGroups": "()"}, ["cs_002f", "sig_0403"], ["grp_", "pts_", "svr_ext_"]),
        ({"SupportedPoints": ""}, ["cs_002f", "sig_0403", "grp_29"], ["pts_", "svr_ext_"]),
        ({"srv_Extensions": ""}, ["cs_002f", "pts_00"], ["svr_ext_"]),
    ],
)
def test_stop_at_error(spark, fields, present, absent):
    got = values(spark, encode.weigh_codes_stop_at_error, **fields)
    assert all(name in got for name in present)
    assert not any(name.startswith(prefix) for name in got for prefix in absent)


def test_layouts_agree(spark):
    flows = flow(spark, CipherSuites="(47-47-4865)", srv_CipherSuite="4865", SignatureAlgs="(1027-2570)")
    weighed = encode.with_scalars(encode.weigh_codes(flows), 1)
    wide = encode.encode_wide(weighed)
    assert wide.columns == S.FEATURE_COLUMNS
    row = wide.first().asDict()
    sparse = {r.feature: r.value for r in encode.encode_sparse(weighed, ["flow_id"]).collect()}
    vector = dict(zip(encode.VECTOR_COLUMNS, encode.encode_vector(weighed).first()[0].toArray()))
    assert {k: v for k, v in row.items() if v and k != S.LABEL} == sparse == {k: v for k, v in vector.items() if v}
    assert row["malware_label"] == 1 and row["svr_ocsp_staple"] == 0 and row["message_len"] == 517
    sums = {r.feature: r.total for r in encode.code_sums(weighed).collect()}
    assert sums == {k: v for k, v in sparse.items() if k in S.CODE_COLUMNS}


def test_ocsp_flag(spark):
    df = spark.createDataFrame([("false",), ("true",), ("",), (None,)], "srv_OCSPStapling string")
    assert [r[0] for r in df.select(encode.ocsp_flag()).collect()] == [0.0, 1.0, 1.0, 1.0]


def test_align_zero_fill(spark):
    df = spark.createDataFrame([(1, None, 2.5)], "id int, cs_0000 double, cs_0001 double")
    got = encode.align_zero_fill(df, ["cs_0001", "cs_0000", "otx_age"], ["id"])
    assert got.columns == ["id", "cs_0001", "cs_0000", "otx_age"] and tuple(got.first()) == (1, 2.5, 0.0, 0.0)


def test_narrow_rows_are_dealt_before_they_are_widened(spark):
    one = spark.range(1000).withColumnRenamed("id", "flow_id").coalesce(1)
    tasks = encode.dealt(one, rows=100).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 10 and sum(r["count"] for r in tasks) == 1000 and max(r["count"] for r in tasks) < 200
    assert encode.dealt(one.where("false"), rows=100).count() == 0
