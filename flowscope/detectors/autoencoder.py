"""Autoencoders trained by synchronous data-parallel steps.

Rows are numbered by a hash of their id; that order alone decides which rows form a mini-batch, so the weights do not
depend on the number of workers. Every mini-batch is dealt out over all workers, and each writes its shares as an Arrow
file whose i-th batch belongs to step i. Training is a barrier stage: in each step a worker reads its share from the
file, takes its part of the gradient, and all workers gather and add the parts, so that all hold the same state. Memory
holds one share and the state, however many rows or epochs there are. A job runs ``job_epochs`` epochs and returns the state,
whose size depends on the layers only; a lost executor costs one job's epochs, since a barrier stage starts anew.

A step exchanges the gradient's bytes between all workers through the driver, some ten milliseconds, so by default a worker
is added only for every ``WORK_PER_WORKER`` multiplications of a mini-batch. Mini-batches of 32 rows and small networks take one
worker for that reason: their steps depend on each other, one chain of ``epochs * rows / batch_size`` of them. The arithmetic
of a step is shared by the members of a team instead (``team``), tasks of one host that meet in shared memory in microseconds.
A member holds one block of mini-batches; the state is there once. Raise ``batch_size`` along with the data.
"""

from __future__ import annotations

import base64
import contextlib
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import BarrierTaskContext, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.detectors.network import Adam, Layout, Member
from flowscope.detectors.team import Team, tasks_for
from flowscope.operators import evaluate
from flowscope.operators.columns import anomaly_flag
from flowscope.operators.sampling import hash_rank, three_way_split
from flowscope.operators.summary import fit_standard
from flowscope.schema import LABEL
from flowscope.session import materialized, scratch_path

# --- fixed values: training settings ---------------------------------------------------------------
HIDDEN = (300, 100, 2, 100, 300)
EPOCHS = 200
BATCH = 32
DEEP_BATCH = 128
VALID_SHARE = 0.05
ACTIVITY_L1 = 1e-6
WEIGHT_SEED = 2
# --- end of fixed values ---------------------------------------------------------------------------
#: Multiplications of a step, forward and back, that take about as long as the exchange of a gradient.
WORK_PER_WORKER = 300_000_000
#: The same for a member of a team, that meets the others in shared memory; products of fewer rows cost nearly as much.
WORK_PER_MEMBER, ROWS_PER_MEMBER = 2_000_000, 8
#: Rows of a stored block of mini-batches, and of one prediction.
BLOCK_ROWS, PREDICTED = 2048, 512
#: Epochs of one job, and so what a lost executor costs at most.
JOB_EPOCHS = 50


def bottleneck_layout(dim: int, hidden: Sequence[int] = HIDDEN) -> Layout:
    return Layout((dim, *hidden, dim), ("elu",) * len(hidden) + ("linear",))


def deep_layout(dim: int, final: int) -> Layout:
    """Halving widths down to ``final`` and back."""
    down = (dim // 2, dim // 4, dim // 8, final)
    return Layout((dim, *down, *reversed(down), dim), ("relu",) * 8 + ("linear",), ACTIVITY_L1)


def matrix(batch: pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


@dataclass(frozen=True)
class Autoencoder:
    """A fitted network over a list of feature columns, with its loss history."""

    layout: Layout
    features: tuple[str, ...]
    flat: np.ndarray
    history: tuple[tuple[int, float, float | None], ...] = ()

    def reconstruct(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        layout, shared = self.layout, df.sparkSession.sparkContext.broadcast(self.flat)

        @F.pandas_udf("array<double>")
        def predict(x: pd.Series) -> pd.Series:
            return pd.Series(list(layout.predict(shared.value, np.stack(x.to_numpy()))))

        return df.withColumn(name, predict(self.inputs()))

    def inputs(self):
        return F.array(*[F.col(c).cast("double") for c in self.features])

    def errors(self, df: DataFrame) -> DataFrame:
        """Add ``loss_mae``, ``loss_mse`` and the mean size of the reconstruction, ``size``, per row.

        The reconstruction itself stays in the task.
        """
        layout, shared = self.layout, df.sparkSession.sparkContext.broadcast(self.flat)

        @F.pandas_udf("loss_mae double, loss_mse double, size double")
        def measure(x: pd.Series) -> pd.DataFrame:
            actual = np.stack(x.to_numpy())
            predicted = layout.predict(shared.value, actual)
            gap = np.abs(predicted - actual)
            return pd.DataFrame(
                {
                    "loss_mae": gap.mean(axis=1),
                    "loss_mse": (gap * gap).mean(axis=1),
                    "size": np.abs(predicted).mean(axis=1),
                }
            )

        return df.withColumn("_e", measure(self.inputs())).select(*df.columns, "_e.*")

    def loss_history(self, spark: SparkSession) -> DataFrame:
        """``epoch, loss, val_loss``, one row per epoch."""
        return spark.createDataFrame(list(self.history), "epoch int, loss double, val_loss double")

    def save(self, spark: SparkSession, path: str) -> None:
        """Weights and layout as one Parquet row."""
        meta = {
            "sizes": self.layout.sizes,
            "activations": self.layout.activations,
            "l1": self.layout.l1,
            "features": self.features,
            "history": self.history,
        }
        row = [(json.dumps(meta), [float(v) for v in self.flat])]
        spark.createDataFrame(row, "meta string, weights array<double>").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Autoencoder:
        row = spark.read.parquet(path).first()
        meta = json.loads(row["meta"])
        layout = Layout(tuple(meta["sizes"]), tuple(meta["activations"]), meta["l1"])
        history = tuple(tuple(entry) for entry in meta["history"])
        return Autoencoder(layout, tuple(meta["features"]), np.array(row["weights"]), history)


def _slicing(folder: str, dim: int, steps: int):
    """Rows (held, step, x) of a worker, sorted, to its two files: (worker, shares, held). Batch i of ``shares`` is the share
    of step i, empty ones included."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        schema = pa.schema([("x", pa.list_(pa.float64(), dim))])
        names = [uuid.uuid4().hex, uuid.uuid4().hex]
        with contextlib.ExitStack() as stack:
            sinks = [stack.enter_context(store.open_output_stream(f"{base}/{n}")) for n in names]
            shares, held = (stack.enter_context(pa.ipc.new_file(sink, schema)) for sink in sinks)

            def put(file, x: np.ndarray) -> None:
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim)
                file.write_batch(pa.RecordBatch.from_arrays([lists], schema=schema))

            done, waiting = 0, np.zeros((0, dim))
            for batch in batches:
                x, at = matrix(batch, "x", dim), batch.column("step").to_numpy()
                kept = batch.column("held").to_numpy(zero_copy_only=False)
                if kept.any():
                    put(held, x[kept])
                x, at = x[~kept], at[~kept]
                while len(at) and at[-1] > done:  # steps before the last one in sight are complete
                    size = int(np.searchsorted(at, done, "right"))
                    put(shares, np.concatenate((waiting, x[:size])))
                    x, at, waiting, done = x[size:], at[size:], np.zeros((0, dim)), done + 1
                waiting = np.concatenate((waiting, x))
            for _ in range(done, steps):
                put(shares, waiting)
                waiting = np.zeros((0, dim))
        yield pa.RecordBatch.from_pydict({"worker": pa.array([TaskContext.get().partitionId()], pa.int32()), "shares": names[:1], "held": names[1:]})

    return write


def _opened(folder: str, name: str) -> pa.ipc.RecordBatchFileReader:
    store, base = pafs.FileSystem.from_uri(folder)
    path = f"{base}/{name}"
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(store, pafs.LocalFileSystem) else store.open_input_file(path))


def _told(state: Adam | Member, steps: int, history: list) -> pa.RecordBatch:
    """What a job returns, as one row."""
    doubles = lambda v: pa.array([v], pa.list_(pa.float64()))
    states = {"flat": doubles(state.flat), "first": doubles(state.first), "second": doubles(state.second)}
    losses = {"loss": doubles([h[0] for h in history]), "val_loss": doubles([h[1] for h in history])}
    return pa.RecordBatch.from_pydict({**states, "steps": [steps], **losses})


def _epochs(layout: Layout, shared, folder: str, dim: int, workers: int, rows: int, batch_size: int, epochs: int):
    """The barrier task of one job of several workers: ``epochs`` epochs from the shared state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        own = next(row for batch in batches for row in batch.to_pylist())
        shares, held = _opened(folder, own["shares"]), _opened(folder, own["held"])
        state = Adam(*shared.value)

        def added(part: np.ndarray) -> np.ndarray:
            parts = context.allGather(base64.b64encode(part.tobytes()).decode())
            return np.sum([np.frombuffer(base64.b64decode(p)) for p in parts], axis=0)

        def share(file, i: int) -> np.ndarray:
            return matrix(file.get_batch(i), "x", dim)

        history = []
        for _ in range(epochs):
            total = 0.0
            for step in range(shares.num_record_batches):
                x, size = share(shares, step), min(batch_size, rows - step * batch_size)
                part = np.zeros(layout.length() + 1)
                if len(x):
                    loss, gradient = layout.loss_and_gradient(state.flat, x)
                    part[:-1], part[-1] = gradient * (len(x) / size), loss * len(x)
                part = added(part)
                state.step(part[:-1])
                total += part[-1]
            gaps = np.zeros(2)
            for i in range(held.num_record_batches):
                x = share(held, i)
                gaps += len(x), float(((layout.predict(state.flat, x) - x) ** 2).mean(axis=1).sum())
            gaps = added(gaps)
            history.append((total / rows, gaps[1] / gaps[0] if gaps[0] else None))
        if own["worker"] == 0:
            yield _told(state, state.steps, history)

    return run


def _team_epochs(layout: Layout, shared, folder: str, files, dim: int, members: int, rows: int, batch_size: int, epochs: int):
    """The barrier task of one job of a single worker, whose arithmetic the members of a team share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        batch = min(rows, batch_size)
        team = Team(folder, members, Member.space(layout, batch, members))
        if team.rank is None:
            return
        member = Member(layout, batch, team.count, team.rank, team.room, team.meet)
        *state, steps = shared.value
        if team.rank == 0:
            member.begin(*state)
        team.meet()
        shares, held = _opened(folder, files["shares"]), _opened(folder, files["held"])
        history = []
        for _ in range(epochs):
            total = gap = 0.0
            for i in range(shares.num_record_batches):
                block = matrix(shares.get_batch(i), "x", dim)
                for at in range(0, len(block), batch_size):
                    steps += 1
                    total += member.step(block[at : at + batch_size], steps)
            judged = 0
            for i in range(held.num_record_batches):
                block = matrix(held.get_batch(i), "x", dim)
                judged += len(block)
                own = block[len(block) * team.rank // team.count : len(block) * (team.rank + 1) // team.count]
                for at in range(0, len(own), PREDICTED):
                    x = own[at : at + PREDICTED]
                    gap += float(((layout.predict(member.flat, x) - x) ** 2).sum())
            total, gap = member.added(total, gap)
            history.append((float(total) / dim / rows, float(gap) / dim / judged if judged else None))
        if team.rank == 0:
            yield _told(member, steps, history)

    return run


def default_members(layout: Layout, batch_size: int) -> int:
    """As many members of a team as a mini-batch has rows and arithmetic for."""
    return max(1, min(batch_size // ROWS_PER_MEMBER, 3 * batch_size * layout.length() // WORK_PER_MEMBER))


def default_workers(layout: Layout, batch_size: int, cores: int) -> int:
    """As many workers as a mini-batch's arithmetic pays for."""
    return max(1, min(cores, 3 * batch_size * layout.length() // WORK_PER_WORKER))


STATE_SCHEMA = "flat array<double>, first array<double>, second array<double>, steps long, loss array<double>, val_loss array<double>"


def fit_autoencoder(
    train: DataFrame,
    features: Sequence[str],
    row_id: str,
    layout: Layout,
    valid: DataFrame | None = None,
    epochs: int = EPOCHS,
    batch_size: int = BATCH,
    workers: int | None = None,
    seed: int = WEIGHT_SEED,
    job_epochs: int = JOB_EPOCHS,
    members: int | None = None,
) -> Autoencoder:
    """Train on ``train``; ``valid`` rows, or the last 5% by hash order, only measure the loss.

    The weights are those of one process that takes the mini-batches one after the other, for any number of ``workers``, or
    of ``members`` of a single worker's team (up to rounding in the order of sums). ``workers`` may not exceed the cores of
    the cluster.
    """
    spark, dim = train.sparkSession, len(features)
    inputs = F.array(*[F.col(c).cast("double") for c in features])
    ranked = lambda df: hash_rank(df.select(row_id, inputs.alias("x")), row_id, seed, name="at").select("at", "x")
    n = train.count()
    rows = n if valid is not None else int(n * (1 - VALID_SHARE))
    if not rows:
        raise ValueError("no rows to train on")
    if workers is None:
        workers = default_workers(layout, min(rows, batch_size), spark.sparkContext.defaultParallelism)
    dealt = ranked(train).withColumn("held", F.col("at") >= rows)
    if valid is not None:
        dealt = dealt.unionByName(ranked(valid).withColumn("held", F.lit(True)))
    in_step, by_turn = F.floor((F.col("at") % batch_size) * workers / batch_size), F.col("at") % workers
    worker = F.when(F.col("held"), by_turn).otherwise(in_step).cast("int")
    # one worker reads blocks of whole mini-batches, several read their share of each
    stored = batch_size * (max(1, BLOCK_ROWS // batch_size) if workers == 1 else 1)
    placed = dealt.select("held", F.floor(F.col("at") / stored).alias("step"), "at", "x", worker.alias("worker"))
    placed = placed.repartitionById(workers, "worker").sortWithinPartitions("held", "at").select("held", "step", "x")
    folder = scratch_path(spark, "shares")
    slices = materialized(placed.mapInArrow(_slicing(folder, dim, -(-rows // stored)), "worker int, shares string, held string"), "slices")

    if workers == 1:
        files = slices.first().asDict()
        members = default_members(layout, min(rows, batch_size)) if members is None else members
        tasks = tasks_for(spark, members)
        starts = spark.range(0, tasks, 1, tasks)

    flat = layout.initial(seed)
    state = (flat, np.zeros_like(flat), np.zeros_like(flat), 0)
    history: list[tuple[int, float, float | None]] = []
    while len(history) < epochs:
        shared = spark.sparkContext.broadcast(state)
        turn = min(job_epochs, epochs - len(history))
        if workers == 1:
            task = _team_epochs(layout, shared, folder, files, dim, members, rows, batch_size, turn)
            out = starts.mapInArrow(task, STATE_SCHEMA, barrier=True).collect()[0]
        else:
            task = _epochs(layout, shared, folder, dim, workers, rows, batch_size, turn)
            out = slices.repartitionById(workers, "worker").mapInArrow(task, STATE_SCHEMA, barrier=True).collect()[0]
        state = (np.array(out["flat"]), np.array(out["first"]), np.array(out["second"]), out["steps"])
        shared.unpersist()
        history += [(len(history) + i + 1, *losses) for i, losses in enumerate(zip(out["loss"], out["val_loss"]))]
    return Autoencoder(layout, tuple(features), state[0], tuple(history))


def autoencoder_scores(
    df: DataFrame, features: Sequence[str], row_id: str, label: str = LABEL, model: Autoencoder | None = None, **training
) -> tuple[DataFrame, Autoencoder]:
    """``(row_id, label, loss_mae, threshold, anomaly)`` for every row.

    Without a model one is trained on the benign rows and the threshold compares the malware
    reconstructions with the benign input (times 4); a given model is compared on all rows (times 3).
    """
    if model is None:
        benign = df.where(F.col(label) == 0)
        model = fit_autoencoder(benign, features, row_id, bottleneck_layout(len(features)), **training)
        base, judged, k = benign, df.where(F.col(label) == 1), evaluate.TRAINED
    else:
        base, judged, k = df, df, evaluate.LOADED
    threshold = evaluate.mae_threshold(base, model.errors(judged), features, ["size"], k).first()[0]
    scored = model.errors(df.select(row_id, label, *features)).select(row_id, label, "loss_mae")
    limit = F.lit(threshold).cast("double")
    return anomaly_flag(scored.withColumn("threshold", limit), "loss_mae", F.col("threshold")), model


@dataclass(frozen=True)
class DeepReport:
    """What the deep autoencoder study returns; all but ``model`` and ``threshold`` are tables."""

    model: Autoencoder
    scored: DataFrame
    threshold: float
    roc: DataFrame
    auc: DataFrame
    errors: DataFrame
    confusion: DataFrame


def deep_autoencoder(
    df: DataFrame,
    features: Sequence[str],
    row_id: str,
    final_features: int,
    label: str = LABEL,
    seed: int = 123,
    epochs: int = EPOCHS,
    **training,
) -> DeepReport:
    """Fit on the benign training rows, scaled on themselves, and judge the validation rows by squared error."""
    split = three_way_split(df, row_id, seed=seed)
    part = lambda name: split.where(F.col("split") == name)
    benign = F.col(label) == 0
    scaling = fit_standard(part("train").where(benign), features)
    train, valid = (scaling.apply(part(name)) for name in ("train", "valid"))
    model = fit_autoencoder(
        train.where(benign),
        features,
        row_id,
        deep_layout(len(features), final_features),
        valid.where(benign),
        epochs,
        DEEP_BATCH,
        **training,
    )
    scored = model.errors(valid.select(row_id, label, *features)).select(row_id, label, "loss_mse")
    threshold = evaluate.mean_roc_threshold(scored, "loss_mse", label).first()[0]
    flagged = scored.withColumn("prediction", (F.col("loss_mse") > F.lit(threshold)).cast("int"))
    return DeepReport(
        model,
        flagged,
        threshold,
        evaluate.roc_curve(scored, "loss_mse", label, origin=True),
        evaluate.roc_auc(scored, "loss_mse", label),
        evaluate.error_by_class(scored, "loss_mse", threshold, label),
        evaluate.confusion_matrix(flagged, label, "prediction"),
    )
