"""WARC archives written and read in parallel, with boundary-chain verification.

Writing: every task writes one archive of whole records in the shared folder and reports its path; only the files of
tasks whose report was kept are read. Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with
the smallest page id is a response and the others are revisits without payload.

Reading: files are cut into blocks. A task looks for the record magic in its block and emits each candidate with its
successor, the offset where the next record must start, and its exit, the first offset beyond the block on the
candidate's chain. Magic inside a payload makes candidates too. Pointer jumping over exits from offset 0 of each file
finds, in logarithmically many rounds, where the chain enters each block; inside a block it is followed from there.
Candidates off the chain are rejected. Payloads are read and hashed for the records that remain.

Defined results: a null html is an empty payload; null ids and urls are left out of the record and read back as null;
control characters in a url are percent-encoded; rows that share the smallest id of a payload are all responses; an
empty table gives no records; further columns are ignored. A file that ends inside a record gives the records before it.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.operators.skew import attach
from flowscope.session import materialized, scratch_path

REVISIT_BYTES = 100
BLOCK_BYTES = 8 << 20

#: The parts of a record.
MAGIC = b"WARC/1.1\r\n"
HEADER_END = b"\r\n\r\n"
RECORD_END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ID = "urn:page:"

FILES = "path string, size bigint, records bigint"
CANDIDATES = (
    "path string, block bigint, offset bigint, next bigint, exit bigint, record_type string, page_id bigint, "
    "url string, refers_to bigint, stated_digest string, body bigint, stop bigint"
)
RECORDS = (
    "path string, offset bigint, next bigint, record_type string, page_id bigint, url string, refers_to bigint, "
    "payload_offset bigint, payload_bytes bigint, payload_digest string"
)


def with_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` as (page_id, url, payload, digest, refers_to); refers_to is null for responses."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    long = rows.where(F.octet_length("payload") >= REVISIT_BYTES)
    groups = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = groups.where("n > 1 and first is not null").select("digest", "first")
    linked = attach(rows, firsts, ["digest"], ["page_id"], hot_source=rows.select("digest"))
    return linked.select(
        "page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )


def clean(url: str) -> str:
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    block = HTTP if refers_to is not None else HTTP + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", None if page_id is None else f"<{ID}{page_id}>"),
        ("WARC-Target-URI", None if url is None else clean(url)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha256:{digest.hex()}"),
        ("WARC-Refers-To", None if refers_to is None else f"<{ID}{refers_to}>"),
        ("WARC-Profile", None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return MAGIC + head.encode() + b"\r\n" + block + RECORD_END


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) in ``folder``, which all executors share: (path, size, records)."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        path, size, n = f"{base}/{uuid.uuid4().hex}.warc", 0, 0  # another attempt of this task takes another name
        with store.open_output_stream(path) as out:
            for batch in batches:
                for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                    data = record(*row)
                    out.write(data)
                    size, n = size + len(data), n + 1
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([n])], names=["path", "size", "records"])

    return materialized(with_revisits(pages).mapInArrow(written, FILES), "files")


def number(field: str | None) -> int | None:
    text = (field or "").strip("<>")
    return int(text[len(ID) :]) if text.startswith(ID) else None


def parsed(head: bytes) -> dict[str, str] | None:
    """Fields of a record's head, without the magic; none if it isn't one."""
    fields = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return fields if fields.get("content-length", "").isdigit() else None


class Block:
    """The bytes of a file from ``begin``; the heads of records that start before ``end`` are read whole."""

    def __init__(self, file: pa.NativeFile, begin: int, end: int, size: int) -> None:
        self.file, self.begin, self.end, self.size = file, begin, end, size
        self.data = file.read_at(min(size, end + len(MAGIC) - 1) - begin, begin)

    def upto(self, offset: int) -> None:
        """Extend the bytes to ``offset``."""
        have = self.begin + len(self.data)
        if offset > have:
            self.data += self.file.read_at(min(offset, self.size) - have, have)

    def candidates(self) -> Iterator[tuple]:
        at = self.data.find(MAGIC)
        while 0 <= at < self.end - self.begin:
            found = self.candidate(self.begin + at)
            if found:
                yield found
            at = self.data.find(MAGIC, at + 1)

    def candidate(self, offset: int) -> tuple | None:
        start = offset + len(MAGIC)
        end = self.data.find(HEADER_END, start - self.begin)
        while end < 0 and self.begin + len(self.data) < self.size:
            self.upto(self.begin + len(self.data) + (1 << 16))
            end = self.data.find(HEADER_END, start - self.begin)
        fields = parsed(self.data[start - self.begin : end]) if end >= 0 else None
        if fields is None:
            return None
        body = self.begin + end + len(HEADER_END)
        stop = body + int(fields["content-length"])
        if stop + len(RECORD_END) > self.size:
            return None
        return (
            offset, stop + len(RECORD_END), fields.get("warc-type"), number(fields.get("warc-record-id")),
            fields.get("warc-target-uri"), number(fields.get("warc-refers-to")),
            fields.get("warc-payload-digest", "").removeprefix("sha256:"), body, stop,
        )


def scanned(folder: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, block, begin, end, size in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                with store.open_input_file(path) as file:
                    rows = list(Block(file, begin, end, size).candidates())
                exits: dict[int, int] = {}
                for row in reversed(rows):  # a successor lies behind its candidate
                    exits[row[0]] = exits.get(row[1], row[1])
                columns = list(zip(*rows, strict=True)) or [()] * 9
                leave = [exits[o] for o in columns[0]]
                arrays = [[path] * len(rows), [block] * len(rows), columns[0], columns[1], leave, *columns[2:]]
                schema = pa.schema([
                    ("path", pa.string()), ("block", pa.int64()), ("offset", pa.int64()), ("next", pa.int64()), ("exit", pa.int64()),
                    ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()),
                    ("stated_digest", pa.string()), ("body", pa.int64()), ("stop", pa.int64()),
                ])
                yield pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    return scan


def entries(candidates: DataFrame, files: DataFrame, rounds: int) -> DataFrame:
    """(path, entry): where each file's chain enters its blocks, by pointer jumping over exits."""
    starts = files.select("path", F.lit(0).cast("bigint").alias("offset"))
    targets = candidates.select("path", F.col("exit").alias("offset")).union(starts).distinct()
    # only offsets that some chain leads to, about one for each block
    jump = materialized(candidates.join(targets, ["path", "offset"], "left_semi").select("path", "offset", F.col("exit").alias("to")), "jump")
    reached = starts
    for _ in range(rounds):
        step = reached.join(jump, ["path", "offset"]).select("path", F.col("to").alias("offset"))
        reached = materialized(reached.union(step).distinct(), "reached")
        onward = jump.select("path", F.col("offset").alias("to"), F.col("to").alias("beyond"))
        jump = materialized(
            jump.join(onward, ["path", "to"], "left").select("path", "offset", F.coalesce("beyond", "to").alias("to")), "jump"
        )
    inside = reached.join(files.select("path", "size"), "path").where("offset < size")  # the last exit is the file's end
    return inside.select("path", F.col("offset").alias("entry"))


def followed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The candidates of a block on the chain from its entry."""
    offsets, nexts = table["offset"].to_pylist(), table["next"].to_pylist()
    place = {o: i for i, o in enumerate(offsets)}
    at, kept = table["entry"][0].as_py(), []
    while at in place:
        kept.append(place[at])
        at = nexts[place[at]]
    return table.drop_columns(["entry"]).take(pa.array(kept, pa.int64()))


def hashed(folder: str):
    """Payload place, size and digest of verified records. A revisit has the digest that it states, and no payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        opened, file = None, None
        for batch in batches:
            places, sizes, digests = [], [], []
            wanted = (batch.column(c).to_pylist() for c in ("path", "record_type", "stated_digest", "body", "stop"))
            for path, kind, stated, body, stop in zip(*wanted, strict=True):
                if path != opened:
                    opened, file = path, store.open_input_file(path)
                block = file.read_at(stop - body, body)
                skip = block.find(HEADER_END)
                payload = memoryview(block)[skip + len(HEADER_END) if skip >= 0 else 0 :]
                places.append(stop - len(payload))
                sizes.append(len(payload))
                digests.append(stated if kind == "revisit" else hashlib.sha256(payload).hexdigest())
            out = batch.select(["path", "offset", "next", "record_type", "page_id", "url", "refers_to"])
            for name, values in (("payload_offset", places), ("payload_bytes", sizes)):
                out = out.append_column(name, pa.array(values, pa.int64()))
            yield out.append_column("payload_digest", pa.array(digests, pa.string()))

    return read


def read_warc(files: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Verified records of ``files`` (path, size, ...) in ``folder``, with the columns of ``RECORDS``."""
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / block_bytes))).alias("block")
    ranges = files.where("size > 0").select("path", blocks, "size").select(
        "path", F.col("block").cast("bigint").alias("block"), (F.col("block") * block_bytes).alias("begin"),
        F.least((F.col("block") + 1) * block_bytes, F.col("size")).alias("end"), "size",
    )
    sizes = files.agg(F.max("size").alias("longest"), F.sum(F.ceil(F.col("size") / block_bytes)).alias("blocks")).first()
    rounds = math.ceil(math.log2(max(1, -(-(sizes.longest or 0) // block_bytes)))) + 1
    tasks = ranges.repartition(max(1, int(sizes.blocks or 1)), "path", "block")
    candidates = materialized(tasks.mapInArrow(scanned(folder), CANDIDATES), "candidates")
    entered = entries(candidates, files, rounds).withColumn("block", F.floor(F.col("entry") / block_bytes).cast("bigint"))
    met = candidates.join(entered, ["path", "block"]).select(*candidates.columns, "entry")
    verified = met.groupBy("path", "block").applyInArrow(followed, CANDIDATES)
    return verified.mapInArrow(hashed(folder), RECORDS)


def payloads(records: DataFrame, folder: str) -> DataFrame:
    """``records`` with the payload bytes of responses; revisits have none of their own."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            data = []
            for path, offset, size in zip(*(batch.column(c).to_pylist() for c in ("path", "payload_offset", "payload_bytes")), strict=True):
                with store.open_input_file(path) as file:
                    data.append(file.read_at(size, offset))
            yield batch.append_column("payload", pa.array(data, pa.binary()))

    return records.mapInArrow(read, RECORDS + ", payload binary")


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the scratch space, read them back, and resolve the revisits' payloads."""
    folder = scratch_path(pages.sparkSession, "warc")
    records = materialized(read_warc(write_warc(pages, folder), folder), "records")
    known = records.where("refers_to is not null").select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    full = records.where("record_type = 'response'").select("page_id", "payload_digest", F.col("payload_bytes").alias("full_bytes"))
    full = full.join(known, ["page_id", "payload_digest"], "left_semi").dropDuplicates(["page_id", "payload_digest"])
    full = full.withColumnRenamed("page_id", "refers_to")
    resolved = attach(records, full, ["refers_to", "payload_digest"], ["page_id"], hot_source=records.select("refers_to", "payload_digest"))
    return resolved.withColumn("payload_bytes", F.coalesce("full_bytes", "payload_bytes")).drop("full_bytes")
