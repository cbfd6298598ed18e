import hashlib

import pytest

from flowscope.llm import warc as W

NESTED = "WARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nxx\r\n\r\n"
ROWS = [
    (1, "http://a", "x" * 120), (2, None, "x" * 120), (3, "u\r\nX: y", None), (4, "u", "small"), (5, "u", "small"), (None, "u", "x" * 120),
    (6, "u", NESTED * 4), (7, "u", "WARC/1.1\r\n"), (1, "http://a", "x" * 120), (8, "ü", "é" * 50), (9, "u", "é" * 50), (10, "u", "z" * 99),
    (11, "u", "z" * 99), (12, "u", NESTED * 4), (13, "u", ""), (14, "u", "WARC/1.1\r\nContent-Length: 1000000\r\n\r\n"), (15, "u", "\r\n\r\n" * 100),
    (None, None, "only without id " * 10),
]
SCHEMA = "page_id bigint, url string, html string, payload string, PATH int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def expected(rows):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        refers = first.get(html) if first.get(html) != i else None
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_round_trip(spark):
    found = W.archived(frame(spark, ROWS)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, found.collect()), key=str) == expected(ROWS)


@pytest.mark.parametrize("block_bytes", [1, 64, 300, 1000, 1 << 20])
def test_any_block_size(spark, tmp_path, block_bytes):
    folder = str(tmp_path / "a")
    rows = ROWS if block_bytes > 1 else ROWS[2:4]
    files = W.write_warc(frame(spark, rows).coalesce(2), folder)
    records = W.read_warc(files, folder, block_bytes)
    got = W.payloads(records.where("record_type = 'response'"), folder).select("page_id", "payload").collect()
    want = [(i, (h or "").encode()) for (i, _, h), (_, _, _, kind, _) in zip(rows, [next(e for e in expected(ROWS) if e[0] == i and e[1] == len((h or "").encode())) for i, _, h in rows], strict=True) if kind == "response"]
    assert sorted(((r.page_id, bytes(r.payload)) for r in got), key=str) == sorted(want, key=str)
    assert records.count() == len(rows)


def test_urls_and_chain(spark, tmp_path):
    folder = str(tmp_path / "a")
    files = W.write_warc(frame(spark, ROWS).coalesce(1), folder)
    rows = W.read_warc(files, folder).orderBy("offset").collect()
    assert rows[0].offset == 0 and rows[-1].next == files.first().size
    assert all(a.next == b.offset for a, b in zip(rows, rows[1:], strict=False))
    assert {r.page_id: r.url for r in rows}[3] == "u%0D%0AX: y" and {r.page_id: r.url for r in rows}[8] == "ü"


def test_file_that_ends_inside_a_record(spark, tmp_path):
    data = b"".join(W.record(i, "u", b"p" * 50, hashlib.sha256(b"p" * 50).digest(), None) for i in range(5))
    (tmp_path / "cut.warc").write_bytes(data[:-20])
    files = spark.createDataFrame([(str(tmp_path / "cut.warc"), len(data) - 20, 5)], W.FILES)
    assert [r.page_id for r in W.read_warc(files, str(tmp_path), 200).orderBy("offset").collect()] == [0, 1, 2, 3]


def test_empty(spark):
    assert W.archived(frame(spark, ROWS).where("false")).count() == 0
