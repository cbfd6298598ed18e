import hashlib
import random
import re
from datetime import date, timedelta

import pytest
import regex
from brute import luhn
from pyspark.sql import functions as F

from flowscope.llm import pii as P

KEY = "test key"


def number(kind, step, value):
    return int(hashlib.sha256(f"{KEY}|{kind}|{step}|{value}".encode()).hexdigest()[:13], 16)


def network(kind, a, b, m, n):
    for i in range(P.ROUNDS):
        a, b = ((a + number(kind, i, b)) % m, b) if i % 2 == 0 else (a, (b + number(kind, i, a)) % n)
    return a, b


def digits(kind, s):
    h = len(s) // 2
    a, b = network(kind, int(s[:h]), int(s[h:]), 10**h, 10 ** (len(s) - h))
    return f"{a:0{h}d}{b:0{len(s) - h}d}"


def laid(s, layout):
    it = iter(s)
    return re.sub("[0-9]", lambda _: next(it), layout)


def replaced(found):
    """Plain version of one value's pseudonym."""
    bare = re.sub("[^0-9]", "", found)
    if "@" in found:
        local, _, domain = found.rpartition("@")
        return hashlib.sha256(f"{KEY}|email|{found.lower()}".encode()).hexdigest()[: min(64, max(10, len(local)))] + "@" + domain
    if re.fullmatch(r"(?i:token|key|secret|password)\s*[=:]\s*[\"']?[0-9A-Fa-f]{16,}", found):
        value = re.search("[0-9A-Fa-f]{16,}$", found)[0]
        long = (hashlib.sha256(f"{KEY}|secret|{value.lower()}".encode()).hexdigest() * (len(value) // 64 + 1))[: len(value)]
        return found[: -len(value)] + (long.upper() if value == value.upper() else long)
    if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", found):
        o = list(map(int, found.split(".")))
        if max(o) > 255:
            return found
        a, b = network("ipv4", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", found):
        try:
            day = (date.fromisoformat(found) - date(1700, 1, 1)).days
        except ValueError:
            return found
        if not 0 <= day < 146_097:
            return found
        a, b = network("date", day // 5411, day % 5411, 27, 5411)
        return (date(1700, 1, 1) + timedelta(a * 5411 + b)).isoformat()
    if re.fullmatch(P.CARD.replace("(?<![0-9])", "").replace("(?![0-9])", ""), found):
        if not (re.match(P.ISSUER, bare) and luhn(bare)):
            return found
        body = bare[:4] + digits("card", bare[4:-1])
        return laid(body + next(c for c in "0123456789" if luhn(body + c)), found)
    return laid(("1" if len(bare) == 11 else "") + digits("phone", bare[-10:]), found)


def apply(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, Value string")
    return [r.text for r in P.pseudonymise(docs, KEY).orderBy("doc_id").collect()]


VALUES = [
    "4785380592391139", "4785-3805-9239-1139", "4785 3805 9239 1139", "378282246310005", "3782 822463 10005", "5555555555554444", "2223003122003222",
    "152.143.123.131", "1.2.3.4", "2024-02-29", "1700-01-01", "2099-12-31", "the.72@mail3.example.com", "a@b.co", "über.34@mail7.example.com",
    "+1 (017) 555-7713", "(212) 555-0100", "212-555-0100", "1.212.555.0100", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff',
    "TOKEN = \"9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "password:0123456789abcdef" + "0" * 80,
]
DECOYS = ["9807915762804490", "4785380592391138", "999.1.1.1", "2023-02-29", "1699-12-31", "4.0.", "12345", "1.2.3.4.5", "2024-02-291", "12:30"]


def test_against_plain_version(spark):
    texts = [f"before {v}, after." for v in VALUES + DECOYS] + [f"{a}### x {b}" for a, b in zip(VALUES, VALUES[::-1], strict=True)]
    pattern = regex.compile(P.ANY)
    got = apply(spark, texts)
    for text, out in zip(texts, got, strict=True):
        assert out == pattern.sub(lambda m: replaced(m[0]), text)
    for value, out in zip(VALUES, got, strict=False):
        assert value not in out and out.startswith("before ") and out.endswith(", after.")
    for text, out in list(zip(texts, got, strict=True))[len(VALUES) : len(VALUES) + len(DECOYS)]:
        assert out == text


def test_formats_and_links(spark):
    got = apply(spark, ["4785380592391139", "x 4785-3805-9239-1139 y", "03/07/1999", "3/7/1999", "31/12/2020", "99/99/1999"])
    assert got[0].isdigit() and luhn(got[0]) and got[0][:4] == "4785"
    assert re.sub("[^0-9]", "", got[1]) == got[0] and re.fullmatch(r"x (\d{4}-){3}\d{4} y", got[1])
    assert re.fullmatch(r"\d{2}/\d{2}/\d{4}", got[2]) and re.fullmatch(r"\d{1,2}/\d{1,2}/\d{4}", got[3])
    assert [int(x) for x in got[2].split("/")] == [int(x) for x in got[3].split("/")]
    assert re.fullmatch(r"\d{2}/\d{2}/\d{4}", got[4]) and got[4] != "31/12/2020" and got[5] == "99/99/1999"


def test_dates_are_permuted(spark):
    days = spark.range(20_000).select(F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    out = [r.text for r in P.pseudonymise(days, KEY).collect()]
    assert len(set(out)) == 20_000 and all("1700-01-01" <= x <= "2099-12-31" for x in out)
    assert all(date.fromisoformat(x) for x in out)


def test_cards_are_permuted(spark):
    rng = random.Random(1)
    bodies = {f"4{rng.randrange(10**14):014d}" for _ in range(2000)}
    cards = [b + next(c for c in "0123456789" if luhn(b + c)) for b in sorted(bodies)]
    out = apply(spark, cards)
    assert len(set(out)) == len(cards) and all(luhn(x) and len(x) == 16 for x in out)


def test_cases(spark):
    long = "word " * 50_000 + "a@b.co"
    got = apply(spark, [None, "", " ", "no values", long, long])
    assert got[:4] == [None, "", " ", "no values"] and got[4] == got[5] and len(got[4]) > 250_000 and "a@b.co" not in got[4][:-20]
    docs = spark.createDataFrame([(1, "a@b.co")], "doc_id bigint, text string")
    assert P.pseudonymise(docs.where("false"), KEY).count() == 0
    assert [(r.id, r.position, r.value) for r in P.found_values(docs, KEY).collect()] == [(1, 0, "a@b.co")]


@pytest.mark.parametrize("other", ["another key"])
def test_key_matters(spark, other):
    docs = spark.createDataFrame([("152.143.123.131",)], "text string")
    assert P.pseudonymise(docs, KEY).first() != P.pseudonymise(docs, other).first()
