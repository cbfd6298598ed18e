"""Token ids as equal-length sequences in Arrow files.

Documents are dealt into shards by ranges of their id, in one exchange. A shard's task encodes its documents in
ascending order and writes two Arrow files of the stream format with a footer, so that any batch can be found at once:

* ``<name>.arrow``: record batches of ``BATCH_ROWS`` sequences; ids (fixed-size list of ``length`` unsigned integers, 16 bits
  wide if the vocabulary allows), mask (which places hold a token; the rest of the last sequence is padding) and first
  (at which places a document begins), both as fixed-size lists of bits;
* ``<name>.documents.arrow``: of each document its id, its place in the shard and its number of ids.

Ids of a document follow each other across sequences and batches; every batch but the last of a shard is full, so
sequence i is row i % BATCH_ROWS of batch i // BATCH_ROWS. Files are not compressed: a mapped file gives sequences and masks
without a copy. Files of task attempts have new names, and only those in the written manifest are read, so a repeated
or lost attempt harms nothing. Shards are numbered and summed in two levels; nothing is collected.

A text is encoded by the tokenizers library. If the vocabulary file has the rules of ``RULES``, this goes by pieces between
spaces and line ends, which those rules never join; a piece of Latin letters, digits and signs is split into its
pre-tokens here, which the library's model then encodes. Ids of recent pieces and pre-tokens are kept, which changes
speed, not results. Other files and other pieces go through the whole library.

Defined results: null and empty texts have the end id only; documents are ordered by id (nulls first), then by a hash
of their text, so repeated rows lie side by side, and a repeated id may be split over shards; texts are processed whole, whatever
their length; an empty table gives an empty manifest; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowscope.llm import tokens
from flowscope.llm.bpe import byte_letters
from flowscope.session import materialized

LENGTH, BATCH_ROWS = 2048, 64
#: Bytes of text in a shard, about.
SHARD_BYTES = 32_000_000
#: Pieces, and pre-tokens, in a generation of those whose ids a worker keeps, and the longest of them.
KEPT_PIECES, KEPT_UNITS, KEPT_LENGTH = 150_000, 300_000, 64
#: Shards that are summed together in the first level of the running totals.
TOGETHER = 1000

#: The normal form and pre-tokens of the vocabulary file, the start of its added tokens, and the characters
#: whose lower case and classes need no look at others.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
RULES = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": PRE_TOKENS}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
]
ADDED = "<|"
LATIN = re.compile("[!-~\xa1-\u024f]+")
STOPS = ".,;:!?"
UNITS = regex.compile(PRE_TOKENS)
BYTES = {byte: letter for letter, byte in byte_letters().items()}

MANIFEST = "shard int, name string, documents bigint, sequences bigint, tokens bigint"


@functools.lru_cache(maxsize=1)
def loaded(path: str):
    """The vocabulary, and whether its rules are those of ``RULES``, once for all tasks of a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    plain = all(not (t["normalized"] or t["lstrip"] or t["rstrip"]) and t["content"].startswith(ADDED) for t in spec["added_tokens"])
    return library, plain and [spec["normalizer"], spec["pre_tokenizer"]] == RULES


class Recent(dict):
    """What ``make`` gave for the latest keys: at most two generations of ``size`` of them."""

    def __init__(self, make: Callable[[str], bytes], size: int) -> None:
        super().__init__()
        self.make, self.size, self.before = make, size, {}

    def __missing__(self, key: str) -> bytes:
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= KEPT_LENGTH:
            if len(self) >= self.size:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Ids of texts as bytes, in a worker."""

    def __init__(self, path: str, end: int) -> None:
        self.library, self.by_word = loaded(path)
        self.kind = id_type(self.library.get_vocab_size(), end)
        self.end = np.array([end], self.kind).tobytes()
        self.model = self.library.model
        self.pieces, self.units = Recent(self.piece, KEPT_PIECES), Recent(self.unit, KEPT_UNITS)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def unit(self, unit: str) -> bytes:
        letters = unit.encode().decode("latin-1").translate(BYTES)
        return np.array([t.id for t in self.model.tokenize(letters)], self.kind).tobytes()

    def piece(self, piece: str) -> bytes:
        if not (piece.isprintable() if piece.isascii() else LATIN.fullmatch(piece)):
            return self.whole(piece)
        lower = piece.lower()
        if not lower:
            return b""
        if lower.isalpha():
            return self.units[lower]
        if lower[-1] in STOPS and lower[:-1].isalpha():
            return self.units[lower[:-1]] + self.units[lower[-1]]
        return self.whole(piece) if ADDED in piece else b"".join(map(self.units.__getitem__, UNITS.findall(lower)))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text and the end id, as little-endian integers."""
        if not self.by_word:
            return [self.whole(t) + self.end for t in texts]
        return [b"".join([*map(self.pieces.__getitem__, word_pieces(t)), self.end]) for t in texts]


def word_pieces(text: str) -> list[str]:
    """Pieces that can be encoded apart: the rules drop white space, no pre-token or added token holds any, and
    neither normal form nor lower case looks across a space or line end."""
    return text.replace("\n", " ").split(" ")


def id_type(size: int, end: int) -> np.dtype:
    return np.dtype("<u2" if max(size, end + 1) <= 1 << 16 else "<u4")


def bits(values: np.ndarray, length: int) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values), length)


class Shard:
    """The two files of a shard while they are written."""

    def __init__(self, folder: str, kind: np.dtype, ident: pa.DataType, length: int) -> None:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        self.name, self.length, self.kind = uuid.uuid4().hex, length, kind
        lists = [("ids", pa.from_numpy_dtype(kind)), ("mask", pa.bool_()), ("first", pa.bool_())]
        self.schema = pa.schema([(n, pa.list_(t, length)) for n, t in lists])
        self.index = pa.schema([("id", ident), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [store.open_output_stream(f"{base}/{self.name}{x}") for x in (".arrow", ".documents.arrow")]
        self.files = [pa.ipc.new_file(s, schema) for s, schema in zip(self.sinks, (self.schema, self.index), strict=True)]
        self.waiting, self.starts = np.zeros(0, kind), np.zeros(0, np.int64)
        self.documents = self.tokens = self.sequences = 0

    def add(self, ids: pa.Array, found: list[bytes]) -> None:
        sizes = np.array([len(x) for x in found], np.int64) // self.kind.itemsize
        starts = self.tokens + np.cumsum(sizes) - sizes
        self.files[1].write_batch(pa.RecordBatch.from_arrays([ids, pa.array(starts), pa.array(sizes)], schema=self.index))
        base = self.tokens - len(self.waiting)
        self.waiting = np.concatenate((self.waiting, np.frombuffer(b"".join(found), self.kind)))
        self.starts = np.concatenate((self.starts, starts - base))
        self.documents, self.tokens = self.documents + len(found), self.tokens + int(sizes.sum())
        size = BATCH_ROWS * self.length
        while len(self.waiting) >= size:
            self.write(self.waiting[:size], size)
            self.starts = self.starts[self.starts >= size] - size
            self.waiting = self.waiting[size:]

    def write(self, ids: np.ndarray, size: int) -> None:
        padded, mask, first = np.zeros(size, self.kind), np.zeros(size, bool), np.zeros(size, bool)
        padded[: len(ids)], mask[: len(ids)] = ids, True
        first[self.starts[self.starts < len(ids)]] = True
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(padded), self.length), bits(mask, self.length), bits(first, self.length)]
        self.files[0].write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.sequences += size // self.length

    def close(self) -> None:
        if len(self.waiting):
            self.write(self.waiting, -(-len(self.waiting) // self.length) * self.length)
        for file, sink in zip(self.files, self.sinks, strict=True):
            file.close()
            sink.close()


def writing(folder: str, path: str, length: int, end: int):
    """Sorted (id, text) of a shard to its row of the manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = Encoder(path, end), None
        for whole in batches:
            for batch in tokens.sliced(whole, 1, tokens.SLICE_BYTES):
                if shard is None:
                    shard = Shard(folder, encoder.kind, batch.column(0).type, length)
                shard.add(batch.column(0), encoder([x or "" for x in batch.column(1).to_pylist()]))
        if shard is not None:
            shard.close()
            values = [TaskContext.get().partitionId(), shard.name, shard.documents, shard.sequences, shard.tokens]
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array([v], k) for v, k in zip(values, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "name", "documents", "sequences", "tokens"])

    return write


def write_sequences(
    docs: DataFrame, folder: str, path: str, length: int = LENGTH, end: int = 1, shard_bytes: int = SHARD_BYTES, text: str = "text", ident: str = "doc_id"
) -> DataFrame:
    """Write the documents' ids under ``folder`` with the vocabulary file at ``path``. Returns the manifest: of each shard its
    number, name, documents, sequences and tokens, and start and first_sequence, those of all shards before it."""
    narrow = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    size = narrow.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    # equal rows may be split: the place makes every key distinct
    keyed = narrow.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("id"), F.asc("hash"), F.asc("place")]
    shards = keyed.repartitionByRange(max(1, -(-size // shard_bytes)), *order).sortWithinPartitions(*order)
    found = materialized(shards.select("id", "text").mapInArrow(tokens.releasing(writing(folder, path, length, end)), MANIFEST), "manifest")
    group = F.floor(F.col("shard") / TOGETHER)
    sums = found.groupBy(group.alias("group")).agg(F.sum("tokens").alias("t"), F.sum("sequences").alias("s"))
    earlier = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # a row for TOGETHER shards
    sums = sums.select("group", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("t", "s")])
    within = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = found.withColumn("group", group).withColumns({"in_t": F.sum("tokens").over(within), "in_s": F.sum("sequences").over(within)})
    start, first = (F.col(a) + F.coalesce(b, F.lit(0)) for a, b in (("t", "in_t"), ("s", "in_s")))
    manifest = parts.join(sums, "group").select(*found.columns, start.alias("start"), first.alias("first_sequence"))
    return materialized(manifest, "manifest")


def opened(folder: str, name: str) -> pa.ipc.RecordBatchFileReader:
    """A file's batches: memory-mapped in a mounted folder, else read by ranges."""
    store, base = pafs.FileSystem.from_uri(folder)
    path = f"{base}/{name}"
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(store, pafs.LocalFileSystem) else store.open_input_file(path))


class Sequences:
    """Random access to the sequences of a shard, without copies where the folder is mounted."""

    def __init__(self, folder: str, name: str) -> None:
        self.reader = opened(folder, f"{name}.arrow")
        self.length = self.reader.schema.field("ids").type.list_size
        full, last = max(self.reader.num_record_batches - 1, 0), 0
        if self.reader.num_record_batches:
            last = len(self.reader.get_batch(full))
        self.count = full * BATCH_ROWS + last

    def __len__(self) -> int:
        return self.count

    def ids(self, number: int) -> np.ndarray:
        return self.batch(number // BATCH_ROWS)[number % BATCH_ROWS * self.length :][: self.length]

    def mask(self, number: int, name: str = "mask") -> pa.BooleanArray:
        lists = self.reader.get_batch(number // BATCH_ROWS).column(name)
        return lists.values.slice(number % BATCH_ROWS * self.length, self.length)

    def batch(self, number: int) -> np.ndarray:
        """All ids of a batch, padding included."""
        return self.reader.get_batch(number).column("ids").values.to_numpy(zero_copy_only=True)

    def tokens(self, start: int, count: int) -> Iterator[np.ndarray]:
        """Pieces of the shard's ids from ``start`` on, over the borders of sequences and batches."""
        size = BATCH_ROWS * self.length
        while count > 0:
            piece = self.batch(start // size)[start % size :][:count]
            yield piece
            start, count = start + len(piece), count - len(piece)


def reading(folder: str, names: list[str], ids: bool):
    """Rows of the manifest (name, start) to those of its documents."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sequences, index = Sequences(folder, row["name"]), opened(folder, f"{row['name']}.documents.arrow")
                for k in range(index.num_record_batches):
                    part = index.get_batch(k)
                    sums, lists = [], []
                    for start, count in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                        pieces, sum_ = list(sequences.tokens(start, count)), 0
                        for piece in pieces:
                            sum_ = zlib.crc32(piece.astype("<u4"), sum_)
                        sums.append(sum_)
                        if ids:
                            lists.append(np.concatenate(pieces).astype(np.int64))
                    starts = pa.compute.add(part.column(1), row["start"])
                    columns = [part.column(0), starts, part.column(2), pa.array(sums, pa.int64())]
                    yield pa.RecordBatch.from_arrays([*columns, *[pa.array(lists, pa.list_(pa.int64()))] * ids], names=names)

    return read


def read_documents(spark: SparkSession, manifest: DataFrame, folder: str, ident_type: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every written document, and ids if wanted: ``start`` is its place among the
    ids of all documents, ids_crc32 the checksum of its ids as little-endian unsigned 32-bit integers."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids]
    fields = f"doc_id {ident_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids
    count = manifest.agg(F.max("shard")).first()[0]
    spread = manifest.select("name", "start", "shard").repartitionById((count or 0) + 1, "shard").select("name", "start")
    return spread.mapInArrow(tokens.releasing(reading(folder, names, ids)), fields)
