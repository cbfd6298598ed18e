import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowscope import schema as S
from flowscope.functions import codes, documents, net, significance, temporal


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_layout():
    assert len(S.FEATURE_COLUMNS) == len(set(S.FEATURE_COLUMNS)) == 519
    assert len(S.CIPHER_COLUMNS) == 351 and len(S.SIGNATURE_COLUMNS) == 36 and len(S.GROUP_COLUMNS) == 49
    assert len(S.EXTENSION_COLUMNS) == 58 and "svr_ext_54" not in S.EXTENSION_COLUMNS
    assert "sig_070A" in S.FEATURE_COLUMNS and "sig_070a" not in S.FEATURE_COLUMNS
    assert S.FEATURE_COLUMNS[0] == "dom_in_tranco_1m" and S.FEATURE_COLUMNS[-1] == "malware_label"


@pytest.mark.parametrize(
    "text,expected",
    [("(4865-47)", [4865, 47]), ("0", [0]), ("65281", [65281]), ("()", []), ("", []), (None, []), ("(1-x-3)", [1, 3])],
)
def test_parse_code_list(spark, text, expected):
    assert one(spark, codes.parse_code_list, text) == expected


def test_code_formats(spark):
    row = spark.range(1).select(
        codes.hex_code(F.lit(47)), codes.hex_code(F.lit(0x12345)), codes.pad_code(F.lit(5)), codes.pad_code(F.lit(65281))
    ).first()
    assert list(row) == ["002f", "12345", "05", "65281"]


@pytest.mark.parametrize("address", ["10.0.0.0", "172.31.255.255", "192.0.0.7", "192.0.0.171", "198.19.255.255", "240.0.0.0", "fe80::1", "::1"])
def test_private(spark, address):
    assert one(spark, net.is_private_ip, address) is True


@pytest.mark.parametrize("address", ["11.0.0.0", "172.32.0.1", "192.0.0.8", "192.0.0.172", "198.20.0.0", "239.255.255.255", "2607::1", "x", None])
def test_not_private(spark, address):
    assert one(spark, net.is_private_ip, address) is False


@pytest.mark.parametrize(
    "text,valid",
    [("1.2.3.4", True), ("1.2.3.0/24", True), ("1.2.3.4/24", False), ("1.2.3.0/255.255.255.0", True), ("0.0.0.0/0", True),
     ("1.2.3.4/33", False), ("1.2.3", False), ("256.1.1.1", False), ("", False), (None, False)],
)
def test_ipv4(spark, text, valid):
    assert one(spark, net.is_ipv4, text) is valid


def test_age_truncates_toward_zero(spark):
    day = lambda text: F.lit(text).cast("timestamp")
    row = spark.range(1).select(
        temporal.age_days(day("2017-07-14 18:08:15"), day("2019-07-27 20:42:54")),
        temporal.age_days(day("2020-01-02 12:00:00"), day("2020-01-01 00:00:00")),
    ).first()
    assert list(row) == [743, -1]


def test_date_range(spark):
    days = [r.day for r in temporal.date_range(spark, dt.date(2024, 1, 30), dt.date(2024, 2, 2)).collect()]
    assert days[0] == dt.date(2024, 1, 30) and days[-1] == dt.date(2024, 2, 2) and len(days) == 4


def test_nested_path(spark):
    df = spark.createDataFrame([([[{"a": 1}]],)], "x array<array<struct<a:int>>>")
    assert df.select(documents.path_value(F.col("x"), df.schema["x"].dataType, ["a"])).first()[0] == 1
    assert df.select(documents.path_value(F.col("x"), df.schema["x"].dataType, ["b"])).first()[0] is None


def test_tail_probabilities():
    assert significance.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert significance.chi2_sf(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-9)
    assert significance.chi2_sf(7.814727903251179, 3) == pytest.approx(0.05, abs=1e-9)
    # F(1, n) is the square of t(n); t(10) = 2.228138851964939 at 5%
    assert significance.f_sf(2.228138851964939**2, 1, 10) == pytest.approx(0.05, abs=1e-9)
