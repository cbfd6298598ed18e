"""Hard negatives by a vertical scan of vectors (branch and bound on decomposed data).

Vectors lie in blocks of rows, and a block stores each dimension as one array with its least and greatest value. An
anchor reads a block's dimensions in descending order of its own magnitudes and adds their products to the partial
scores of its candidates. What the dimensions still to come can add at least and at most follows from their bounds, so
each candidate's score has an interval. After each step a bitmap keeps the candidates that may still count:

* positives (rows of the anchor's label): those whose upper bound reaches the k-th best lower bound so far;
* negatives (rows of other labels): those whose interval meets the score window of a positive and can still reach the
  window's k-th best score; lower bounds count towards it only if the interval lies within the window.

Dimensions are read until none is left, so what remains has exact integer scores.

Rows are dealt into blocks once and written. A task holds a group of at most ``GROUP_BLOCKS`` blocks and streams the
written anchors past it; the best scores of earlier blocks prune the later ones. It returns at most k rows for each
anchor (and window), so neither pairs nor scores of all rows ever become rows, and a large group of equal vectors costs
no more than others. The k best of all groups are merged by one exchange on the anchor.

Anchors are streamed from the shared folder, never collected; their number may grow with the table.

Defined results: rows with a null label or vector or a null component take no part; of vectors of different lengths
the shorter ones count as filled with zeros; every row is its own candidate, also where rows repeat an id or whole
rows repeat (an anchor is never its own positive, its copies are); ids may be null: such rows come last among ties; a
product sum that could leave 64 bits raises; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowscope.llm.tokens import releasing
from flowscope.session import materialized, scratch_path

BLOCK_ROWS = 4096
#: Blocks that a task holds at most.
GROUP_BLOCKS = 64
#: Dimensions of the first step; each further step takes as many as all before it.
FIRST_STEP = 8
#: Fixed bounds of the 64-bit numbers.
LOWEST, HIGHEST = -(2**63), 2**63 - 1

BLOCK_FIELDS = "block bigint, ids array<bigint>, labels binary, places binary, columns binary, lows binary, highs binary, anchors binary"


def to_blocks(dims: int):
    """(id, label, vector, anchor) to blocks, whose rows are ordered by label."""

    def block(number: int, batch: pa.RecordBatch) -> list:
        n = len(batch)
        labels = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        lists = batch.column(2)
        sizes = np.diff(lists.offsets.to_numpy())
        matrix = np.zeros((n, dims), np.int64)
        matrix[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(labels, kind="stable")
        columns = np.ascontiguousarray(matrix[order].T)
        anchors = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)[order]
        arrays = [labels[order], order, columns, columns.min(1), columns.max(1), np.flatnonzero(anchors)]
        return [number, batch.column(0).take(pa.array(order)).to_pylist(), *[np.ascontiguousarray(a, np.int64).tobytes() for a in arrays]]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            nonlocal waiting, number
            rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, number = [], number + 1
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 6]
            columns = [pa.array([v], k) for v, k in zip(block(number - 1, rows), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "labels", "places", "columns", "lows", "highs", "anchors"])

        for batch in batches:
            at = 0
            while at < len(batch):
                room = BLOCK_ROWS - sum(map(len, waiting))
                waiting.append(batch.slice(at, room))
                at += room
                if sum(map(len, waiting)) == BLOCK_ROWS:
                    yield flush()
        if sum(map(len, waiting)):
            yield flush()

    return dealt


class Block:
    def __init__(self, row: dict, dims: int) -> None:
        of = {k: np.frombuffer(row[k], np.int64) for k in ("labels", "places", "columns", "lows", "highs", "anchors")}
        self.number, self.known = row["block"], row["ids"]
        self.ids = np.array([HIGHEST if x is None else x for x in self.known], np.int64)
        self.labels, self.lows, self.highs, self.anchors = of["labels"], of["lows"], of["highs"], of["anchors"]
        self.numbers = row["block"] * BLOCK_ROWS + of["places"]
        self.columns = of["columns"].reshape(dims, -1)

    def of_label(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right"))


def extracted(dims: int):
    """The anchors of blocks: (anchor, id, label, vector)."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, dims)
                at = block.anchors
                vectors = [np.ascontiguousarray(block.columns[:, i]).tobytes() for i in at.tolist()]
                ids = [block.known[i] for i in at.tolist()]
                columns = [pa.array(block.numbers[at]), pa.array(ids, pa.int64()), pa.array(block.labels[at]), pa.array(vectors, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "id", "label", "vector"])

    return extract


class Reading:
    """How an anchor reads a block: its dimensions by descending magnitude, in steps, with the bounds of the rest."""

    def __init__(self, vector: np.ndarray, block: Block) -> None:
        self.order = np.argsort(-np.abs(vector), kind="stable")
        self.weights = vector[self.order]
        one, two = self.weights * block.lows[self.order], self.weights * block.highs[self.order]
        self.least = np.concatenate((np.cumsum(np.minimum(one, two)[::-1])[::-1], [0]))
        self.most = np.concatenate((np.cumsum(np.maximum(one, two)[::-1])[::-1], [0]))
        self.columns = block.columns

    def steps(self) -> Iterator[tuple[int, int]]:
        begin, dims = 0, len(self.order)
        while begin < dims:
            end = min(dims, max(FIRST_STEP, 2 * begin))
            yield begin, end
            begin = end

    def added(self, scores: np.ndarray, rows: np.ndarray, begin: int, end: int) -> np.ndarray:
        picked = self.columns[self.order[begin:end]]
        part = picked if len(rows) == picked.shape[1] else picked[:, rows]
        return scores + self.weights[begin:end] @ part


def kth(values: np.ndarray, k: int) -> int:
    """The k-th greatest value."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else LOWEST


def positives(block: Block, vector: np.ndarray, number: int, label: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the label that may be among the k best, those of ``floor`` or more, with their scores."""
    rows = np.arange(*block.of_label(label))
    rows = rows[block.numbers[rows] != number]
    scores, reading = np.zeros(len(rows), np.int64), Reading(vector, block)
    for begin, end in reading.steps():
        if not len(rows):
            break
        scores = reading.added(scores, rows, begin, end)
        floor = max(floor, kth(scores + reading.least[end], k))
        alive = scores + reading.most[end] >= floor
        if not alive.all():
            rows, scores = rows[alive], scores[alive]
    return rows, scores


def negatives(block: Block, vector: np.ndarray, label: int, k: int, windows: list[tuple[int, int]], floors: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of other labels that may be among the k best of a window (low, high), with their scores."""
    begin, end = block.of_label(label)
    rows = np.concatenate((np.arange(begin), np.arange(end, len(block.ids))))
    scores, reading, floors = np.zeros(len(rows), np.int64), Reading(vector, block), list(floors)
    for begin, end in reading.steps():
        if not len(rows):
            break
        scores = reading.added(scores, rows, begin, end)
        least, most = scores + reading.least[end], scores + reading.most[end]
        alive = np.zeros(len(rows), bool)
        for w, (low, high) in enumerate(windows):
            meets = (least <= high) & (most >= max(low, floors[w]))
            sure = meets & (least >= low) & (most <= high)
            floors[w] = max(floors[w], kth(least[sure], k))
            alive |= meets & (most >= floors[w])
        if not alive.all():
            rows, scores = rows[alive], scores[alive]
    return rows, scores


class Best:
    """The k best (score, id) of several blocks: greater scores first, then smaller ids."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, []

    def floor(self) -> int:
        return self.rows[-1][0] if len(self.rows) == self.k else LOWEST

    def add(self, block: Block, rows: np.ndarray, scores: np.ndarray) -> None:
        if len(rows):
            ids = block.ids[rows]
            first = np.lexsort((ids, -scores))[: self.k]
            new = [(int(scores[i]), int(ids[i]), block.known[rows[i]]) for i in first.tolist()]
            self.rows = sorted(self.rows + new, key=lambda r: (-r[0], r[1], r[2] is None))[: self.k]


def streamed(path: str) -> Iterator[dict]:
    """Rows of a written table, batch by batch."""
    store, base = pafs.FileSystem.from_uri(path)
    for batch in pads.dataset(base, filesystem=store, format="parquet").to_batches(batch_size=1024):
        yield from batch.to_pylist()


def met(anchors: str, dims: int, k: int, windows: tuple[int, int] | None):
    """Blocks to (anchor, high, id, score): the k best positives of each written anchor (high is null), or the k best
    negatives of each of its windows."""
    names = ["anchor", "high", "id", "score"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [Block(row, dims) for batch in batches for row in batch.to_pylist()]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for anchor in streamed(anchors) if blocks else ():
            vector = np.frombuffer(anchor["vector"], np.int64)
            if windows is None:
                best = Best(k)
                for block in blocks:
                    best.add(block, *positives(block, vector, anchor["anchor"], anchor["label"], k, best.floor()))
                rows += [(anchor["anchor"], None, known, score) for score, _, known in best.rows]
            else:
                spans = [(-(-windows[0] * s // 100), windows[1] * s // 100) for s in anchor["scores"]]
                bests = [Best(k) for _ in spans]
                for block in blocks:
                    kept, scores = negatives(block, vector, anchor["label"], k, spans, [b.floor() for b in bests])
                    for best, (low, high) in zip(bests, spans, strict=True):
                        inside = (scores >= low) & (scores <= high)
                        best.add(block, kept[inside], scores[inside])
                for best, high in zip(bests, anchor["scores"], strict=True):
                    rows += [(anchor["anchor"], high, known, score) for score, _, known in best.rows]
            if len(rows) >= 10_000:
                yield batch()
        if rows:
            yield batch()

    return scan


def written(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each key, ranked from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    positive_count: int = 5,
    negative_count: int = 5,
    percent: tuple[int, int] = (80, 100),
    ident: str = "vec_id",
    label: str = "label",
    vector: str = "vector",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which ``anchors`` holds.

    Components are whole numbers. For each anchor and each of its best ``positive_count`` other rows of its label, the
    best ``negative_count`` rows of other labels with a score from ``percent[0]`` to ``percent[1]`` per cent of the positive's.
    """
    spark: SparkSession = rows.sparkSession
    whole = F.transform(F.col(vector), lambda x: x.cast("bigint"))
    narrow = rows.select(F.col(ident).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("of"), whole.alias("vector"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    narrow = narrow.where(F.col("of").isNotNull() & F.coalesce(F.forall("vector", lambda x: x.isNotNull()), F.lit(False)))
    size = narrow.agg(F.max(F.size("vector")).alias("dims"), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("decimal(20,0)"))))).alias("most")).first()
    dims = max(size.dims or 0, 1)
    if dims * int(size.most or 0) ** 2 > HIGHEST // 4:
        raise ValueError("the scores could leave 64 bits")

    blocks = materialized(narrow.mapInArrow(releasing(to_blocks(dims)), BLOCK_FIELDS), "blocks")
    count = blocks.count()
    tasks = max(1, min(count, max(spark.sparkContext.defaultParallelism, -(-count // GROUP_BLOCKS))))
    # gapless numbers of blocks, so that every task gets as many
    place = F.row_number().over(Window.orderBy("block")) - 1
    turn = materialized(blocks.select("block").withColumn("turn", (place % tasks).cast("int")), "turns")
    groups = blocks.join(turn, "block").repartitionById(tasks, "turn").drop("turn")

    queries = written(blocks.mapInArrow(releasing(extracted(dims)), "anchor bigint, id bigint, label bigint, vector binary"), "anchors")
    fields = "anchor bigint, high bigint, id bigint, score bigint"
    near = ranked(groups.mapInArrow(releasing(met(queries, dims, positive_count, None)), fields), ["anchor"], positive_count)
    near = materialized(near.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place")), "positives")
    # at most positive_count scores for each anchor
    scores = near.groupBy("anchor").agg(F.collect_set("positive_score").alias("scores"))
    windows = written(spark.read.parquet(queries).join(scores, "anchor"), "windows")
    far = ranked(groups.mapInArrow(releasing(met(windows, dims, negative_count, percent)), fields), ["anchor", "high"], negative_count)
    far = far.select("anchor", F.col("high").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.join(spark.read.parquet(queries).select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return named.join(far, ["anchor", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
