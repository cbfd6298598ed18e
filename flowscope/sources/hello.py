"""Handshake record files: CSV with a header, every field a string.

A source may be many files, each with its own header: columns are matched by the header of the file they stand in.
``flow_id`` is the number of a record's line, counted over all files in the order of their paths, so it follows file order and
stays the same however the files are split into tasks or packed together.

Lines are read as text: quoted fields may hold separators and doubled quotes but no line ends. Blank lines are
skipped; fields that a line lacks are empty; columns the schema does not know are left out; a header that lacks one
is an error.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowscope import schema as S
from flowscope.operators.skew import attach
from flowscope.session import materialized

#: Different headers of one source.
MAX_HEADERS = 100
#: Rows of the block table that are broadcast at most; a row holds a path.
BROADCAST_BLOCKS = 50_000


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines with their file, the start of their block in it, and a place that grows within the block."""
    source = spark.read.text(path if isinstance(path, str) else list(path))
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return source.select(*where, F.monotonically_increasing_id().alias("place"), "value", F.xxhash64("value").alias("hash"))


def _blocks(lines: DataFrame) -> DataFrame:
    """For each block the lines of all blocks before it (``offset``), its first place, and its file's header: where it
    stands and its hash. Counted in one pass; a block's row has fixed width but for the path."""
    filled = F.trim("value") != ""
    place, hashed = F.when(filled, F.col("place")), F.when(filled, F.col("hash"))
    counted = lines.groupBy("file", "block").agg(
        F.min("place").alias("begin"), F.count("*").alias("n"), F.min(place).alias("head"), F.min_by(hashed, place).alias("kind")
    )
    counted = materialized(counted, "blocks")
    with_head = F.when(F.col("head").isNotNull(), F.col("block"))
    files = counted.groupBy("file").agg(F.sum("n").alias("size"), F.min_by("head", with_head).alias("head"), F.min_by("kind", with_head).alias("kind"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("earlier", F.coalesce(F.sum("size").over(before(Window.orderBy("file"))), F.lit(0)))  # a row for each file
    inside = F.coalesce(F.sum("n").over(before(Window.partitionBy("file").orderBy("block"))), F.lit(0))
    placed = counted.withColumn("inside", inside).select("file", "block", "begin", "inside").join(files, "file")
    return materialized(placed.select("file", "block", "begin", "head", "kind", (F.col("earlier") + F.col("inside")).alias("offset")), "blocks")


def _fields(header: str, names: Sequence[str]) -> Column:
    """The named fields of a line under a header. The line is parsed once: fields are taken from a bound variable, as a parse
    that is written out for each field would be made for each field."""
    found = [c.strip() for c in next(csv.reader([header.removeprefix("﻿")]))]
    missing = [n for n in names if n not in found]
    if missing:
        raise ValueError(f"the header {header!r} lacks {', '.join(missing)}")
    parsed = F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(found))), {"escape": '"', "mode": "PERMISSIVE"})
    record = lambda line: F.struct(*[F.coalesce(line[f"c{found.index(n)}"], F.lit("")).alias(n) for n in names])
    return F.transform(F.array(parsed), record)[0]


def _read(spark: SparkSession, path: str | Sequence[str], fields, with_id: bool) -> DataFrame:
    names = fields.fieldNames()
    lines = _lines(spark, path)
    blocks = _blocks(lines)
    kinds = blocks.where("kind is not null").groupBy("kind").agg(F.min("file").alias("file")).limit(MAX_HEADERS + 1).collect()
    if len(kinds) > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} different headers")
    record = F.lit(None).cast(fields)
    for kind, file in kinds:
        header = lines.where((F.col("file") == file) & (F.col("hash") == kind)).first()["value"]
        record = F.when(F.col("kind") == kind, _fields(header, names)).otherwise(record)
    placed = attach(lines.drop("hash"), blocks, ["file", "block"], ["place"], limit=BROADCAST_BLOCKS)
    rows = placed.where((F.trim("value") != "") & (F.col("place") != F.col("head")))
    number = (F.col("offset") + F.col("place") - F.col("begin")).alias("flow_id")
    return rows.select(*[number] * with_id, record.alias("record")).select(*["flow_id"] * with_id, "record.*")


def read_client_hello(spark: SparkSession, path: str | Sequence[str], with_id: bool = True) -> DataFrame:
    return _read(spark, path, S.CLIENT_HELLO, with_id)


def read_server_hello(spark: SparkSession, path: str | Sequence[str], with_id: bool = True) -> DataFrame:
    """``flow_id`` grows in file order, which is what "first server" means to the pairing."""
    return _read(spark, path, S.SERVER_HELLO, with_id)
