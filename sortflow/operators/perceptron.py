"""A perceptron with hidden layers on all sparse features, trained by synchronous mini-batches over Spark.

Rows are dealt into mini-batches by a hash of their id and written once,
partitioned by batch. A step is one job over the files of one batch: every task
adds up the gradient of its rows, the sums are cut into blocks of parameters, and
blocks are added up over groups of at most ``FAN_IN`` tasks, level by level, each
level a shuffle by (block, group). So no task sees more than ``FAN_IN`` copies of
its blocks, and the driver sees one gradient, which is as large as the model.
Adam moves the weights there. The steps are those of a plain loop over the same
batches: how the rows are spread changes no more than the order of additions.

After each epoch the validation rows are scored. The best epoch so far (strictly
higher macro F1, from -1) keeps its weights; ``patience`` epochs without a better
one end the training, which returns to the best. The history is a table.

Defined results: rows without a label are left out; a null name or content is empty; a null id is an id of its own;
repeated rows count as often as they come; without validation rows all epochs run
and the last weights are returned; without any labelled training row there is
nothing to learn, an error. Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from sortflow.functions.paths import featurize_name
from sortflow.functions.vocabulary import SEED
from sortflow.operators.classify import Scorer, scorer_of
from sortflow.operators.features import FEATURE_BLOCKS, Block, fit_features
from sortflow.plans.workspace import materialise, scratch, shuffles_dropped

# The layers and the longest training of the classifier.
HIDDEN = (256, 128)
MAX_EPOCHS = 250

PATIENCE = 10
BATCH_ROWS = 2_000
RATE = 2e-3
DECAY = 1e-4
BETAS = (0.9, 0.999)
#: Parameters of one block of a gradient: 1 MB.
BLOCK = 1 << 18
#: Tasks whose blocks are added up by one task of the next level.
FAN_IN = 32
#: Rows of one gradient task at least, and rows multiplied at once.
TASK_ROWS = 128
HISTORY = "run string, epoch int, loss double, val_accuracy double, val_macro_f1 double"


@dataclass
class Perceptron:
    """Labels, layer widths, and all weights and biases as one vector, layer after layer."""

    labels: list[str]
    widths: tuple[int, ...]
    flat: np.ndarray

    @classmethod
    def fresh(cls, labels: Sequence[str], widths: Sequence[int], seed: int = SEED) -> Perceptron:
        """Seeded weights, uniform within the bound that keeps variances equal over layers; biases are 0."""
        random, parts = np.random.default_rng(seed), []
        for a, b in zip(widths, widths[1:]):
            bound = np.sqrt(6.0 / (a + b))
            parts += [random.uniform(-bound, bound, a * b), np.zeros(b)]
        return cls(list(labels), tuple(widths), np.concatenate(parts).astype(np.float32))

    def layers(self, flat: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(weights, biases) per layer, as views of ``flat``."""
        flat, at, out = self.flat if flat is None else flat, 0, []
        for a, b in zip(self.widths, self.widths[1:]):
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def forward(self, x: np.ndarray, used: np.ndarray) -> list[np.ndarray]:
        """Output of every layer, probabilities last, for rows whose features ``used`` are ``x`` and whose others are 0."""
        layers, outputs = self.layers(), []
        for i, (weights, biases) in enumerate(layers):
            z = (x @ weights[used] if i == 0 else outputs[-1] @ weights) + biases
            if i < len(layers) - 1:
                outputs.append(np.maximum(z, 0))
            else:
                e = np.exp(z - z.max(axis=1, keepdims=True))
                outputs.append(e / e.sum(axis=1, keepdims=True))
        return outputs

    def add_gradient(self, into: np.ndarray, x: np.ndarray, used: np.ndarray, y: np.ndarray) -> float:
        """Add the gradient of the summed cross-entropy to ``into``; returns that sum."""
        outputs, layers, sums = self.forward(x, used), self.layers(), self.layers(into)
        rows = np.arange(len(y))
        loss = -np.log(np.maximum(outputs[-1][rows, y], 1e-12)).sum()
        delta = outputs[-1].copy()
        delta[rows, y] -= 1
        for i in range(len(layers) - 1, -1, -1):
            sums[i][1][:] += delta.sum(axis=0)
            if i == 0:
                sums[0][0][used] += x.T @ delta
            else:
                sums[i][0][:] += outputs[i - 1].T @ delta
                delta = (delta @ layers[i][0].T) * (outputs[i - 1] > 0)
        return float(loss)


@dataclass
class Adam:
    """Steps by running means of the gradients and of their squares."""

    size: int
    rate: float = RATE
    decay: float = DECAY
    steps: int = 0
    first: np.ndarray = field(init=False)
    second: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.first, self.second = np.zeros(self.size, np.float32), np.zeros(self.size, np.float32)

    def move(self, flat: np.ndarray, summed: np.ndarray, rows: int) -> np.ndarray:
        """New weights after the gradient ``summed`` over ``rows`` rows; weights decay towards 0."""
        g = (summed + self.decay * flat) / rows
        self.steps += 1
        self.first = BETAS[0] * self.first + (1 - BETAS[0]) * g
        self.second = BETAS[1] * self.second + (1 - BETAS[1]) * g * g
        rate = self.rate * np.sqrt(1 - BETAS[1] ** self.steps) / (1 - BETAS[0] ** self.steps)
        return (flat - rate * self.first / (np.sqrt(self.second) + 1e-8)).astype(np.float32)


# --- sparse rows in Arrow -----------------------------------------------------------------------------


def blocks_of_rows(vectors: pa.Array, rows: int = TASK_ROWS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, x, used) of runs of rows of a vector column: only features that a run holds become columns."""
    if isinstance(vectors, pa.ExtensionArray):
        vectors = vectors.storage
    for first in range(0, len(vectors), rows):
        part = vectors.slice(first, rows)
        kind, _, indices, values = part.flatten()
        lengths = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(part)), lengths)
        at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        sparse = np.repeat(pc.equal(kind, 0).to_numpy(zero_copy_only=False).astype(bool), lengths)
        at[sparse] = indices.flatten().to_numpy(zero_copy_only=False)
        column = np.zeros(at.max(initial=-1) + 1, np.int64)
        column[at] = 1
        used = np.flatnonzero(column)
        column[used] = np.arange(len(used))
        x = np.zeros((len(part), len(used)), np.float32)
        x[row, column[at]] = values.flatten().to_numpy(zero_copy_only=False)
        yield first, x, used


def _gradients(shared):
    """(block, group, values) of the task's summed gradient, loss and row count last."""

    def gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Perceptron = shared.value
        summed = np.zeros(len(model.flat) + 2, np.float32)
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, x, used in blocks_of_rows(batch.column(1)):
                own = y[first : first + len(x)]
                summed[-2] += model.add_gradient(summed[:-2], x, used, own)
                summed[-1] += len(own)
        if summed[-1]:
            task = TaskContext.get().partitionId()
            yield from _block_rows({(at, task): summed[at * BLOCK : (at + 1) * BLOCK] for at in range(-(-len(summed) // BLOCK))})

    return gradients


def _block_rows(sums: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (block, group), part in sums.items():
        columns = [pa.array([block], pa.int32()), pa.array([group], pa.int32()), pa.array([part.astype("<f4").tobytes()])]
        yield pa.RecordBatch.from_arrays(columns, ["block", "task", "part"])


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per (block, group) of the task, whatever number of copies came in."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for *key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            part = np.frombuffer(raw.as_buffer(), "<f4")
            if tuple(key) in sums:
                sums[tuple(key)] += part
            else:
                sums[tuple(key)] = part.copy()
    yield from _block_rows(sums)


def summed_gradient(rows: DataFrame, model: Perceptron, tasks: int) -> tuple[np.ndarray, float, int]:
    """(gradient, loss, rows) summed over ``rows`` (y, features), which come in ``tasks`` partitions."""
    spark, schema = rows.sparkSession, "block int, task int, part binary"
    shared = spark.sparkContext.broadcast(model)
    size = len(model.flat) + 2
    blocks = -(-size // BLOCK)
    found = rows.select("y", "features").mapInArrow(_gradients(shared), schema)
    while tasks > 1:
        groups, across = -(-tasks // FAN_IN), min(blocks, spark.sparkContext.defaultParallelism)
        grouped = found.withColumn("task", F.expr(f"cast(task % {groups} as int)"))
        # Dealt by number, not by hash: the job waits for the task with the most blocks.
        dealt = grouped.repartitionById(across * groups, F.expr(f"block % {across} + {across} * task"))
        found, tasks = dealt.mapInArrow(_add_blocks, schema), groups
    out = np.zeros(size, np.float32)
    # One row per block: the blocks of all groups have been added up. At most a model's size arrives.
    for r in found.select("block", "part").toArrow().to_pylist():
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(r["part"]) // 4] += np.frombuffer(r["part"], "<f4")
    shared.destroy()
    return out[:-2], float(out[-2]), int(out[-1])


# --- training -----------------------------------------------------------------------------------------


def deal_batches(vectors: DataFrame, id_col: str, steps: int, tasks: int, seed: int) -> list[DataFrame]:
    """The rows (id, y, features) written once, by mini-batch; one frame per mini-batch."""
    spark = vectors.sparkSession
    dealt = vectors.select(
        F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(steps)).cast("int").alias("batch"),
        F.pmod(F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col("features")), F.lit(tasks)).alias("__task"),
        "y",
        "features",
    )
    path = scratch(spark, "mini-batches")
    dealt.repartition(min(steps * tasks, 2_000), "batch", "__task").drop("__task").write.partitionBy("batch").parquet(path)
    schema = dealt.drop("__task", "batch").schema.add("batch", T.IntegerType())
    table = spark.read.schema(schema).parquet(path)
    return [table.where(F.col("batch") == b) for b in range(steps)]


def confusion(rows: DataFrame, model: Perceptron) -> np.ndarray:
    """Counts of (label, prediction) over (y, features)."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.forward(x, used)[-1].argmax(axis=1) for _, x, used in blocks_of_rows(batch.column(1))]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found), pa.int32())], ["y", "guess"])

    out = np.zeros((len(model.labels), len(model.labels)), np.int64)
    counted = rows.select("y", "features").mapInArrow(predict, "y int, guess int").groupBy("y", "guess").count()
    for r in counted.collect():
        out[r["y"], r["guess"]] = r["count"]
    shared.destroy()
    return out


def macro_f1(matrix: np.ndarray) -> float:
    """Mean F1 of the labels that occur as truth or as prediction."""
    hits, said = np.diag(matrix), matrix.sum(axis=0) + matrix.sum(axis=1)
    occurs = said > 0
    return float((2 * hits[occurs] / said[occurs]).mean()) if occurs.any() else float("nan")


@dataclass
class Training:
    """Weights of the best epoch, every epoch's figures as a table, and where it stopped."""

    model: Perceptron
    history: DataFrame
    best_epoch: int | None
    last_epoch: int


def train_on_vectors(
    train: DataFrame,
    validation: DataFrame,
    labels: Sequence[str],
    width: int,
    id_col: str = "id",
    hidden: Sequence[int] = HIDDEN,
    max_epochs: int = MAX_EPOCHS,
    patience: int = PATIENCE,
    batch_rows: int = BATCH_ROWS,
    rate: float = RATE,
    seed: int = SEED,
    run: str = "perceptron",
    keep_in: str | None = None,
) -> Training:
    """Train on (id, y, features), validate on (y, features).

    With ``keep_in``, the weights of every improved epoch are stored below that
    folder, on storage of the cluster, so a lost driver loses no more than the
    epochs since.
    """
    spark = train.sparkSession
    rows = train.count()
    if not rows:
        raise ValueError("No labelled rows to train on.")
    steps = -(-rows // batch_rows)
    tasks = min(spark.sparkContext.defaultParallelism, -(-min(rows, batch_rows) // TASK_ROWS))
    batches = deal_batches(train, id_col, steps, tasks, seed)
    files = [b.rdd.getNumPartitions() for b in batches]
    model = Perceptron.fresh(labels, (width, *hidden, len(labels)), seed)
    adam, random = Adam(len(model.flat), rate), np.random.default_rng(seed)
    best, best_epoch, best_metric, history = model.flat, None, -1.0, []
    for epoch in range(1, max_epochs + 1):
        lost = 0.0
        for step in random.permutation(steps):
            with shuffles_dropped(spark):
                gradient, loss, seen = summed_gradient(batches[step], model, files[step])
            lost += loss
            if seen:
                model.flat = adam.move(model.flat, gradient, seen)
        matrix = confusion(validation, model)
        checked, metric = int(matrix.sum()), macro_f1(matrix)
        accuracy = float(np.trace(matrix)) / checked if checked else float("nan")
        history.append((run, epoch, lost / rows, accuracy, metric))
        if metric > best_metric:
            best, best_epoch, best_metric = model.flat, epoch, metric
            if keep_in is not None:
                save_perceptron(spark, model, f"{keep_in}/epoch-{epoch}")
        elif checked and epoch - (best_epoch or 0) >= patience:
            break
    if best_epoch is not None:
        model.flat = best
    table = materialise(spark.createDataFrame(history, HISTORY).coalesce(1), "training-history")
    return Training(model, table, best_epoch, history[-1][1] if history else 0)


@dataclass
class FileClassifier:
    """Fitted features and the perceptron on them."""

    features: PipelineModel
    training: Training

    @property
    def labels(self) -> list[str]:
        return self.training.model.labels


def train_perceptron(
    corpus: DataFrame,
    id_col: str,
    blocks: tuple[Block, ...] = FEATURE_BLOCKS,
    validation_share: float = 0.1,
    seed: int = SEED,
    **options,
) -> FileClassifier:
    """Fit on (filename, content, label), all features; ``validation_share`` of the rows, by a hash of the id, decide when to stop."""
    name, content = F.coalesce(featurize_name(F.col("filename")), F.lit("")), F.coalesce("content", F.lit(""))
    rows = corpus.select(id_col, name.alias("filename"), content.alias("content"), "label")
    prepared = materialise(rows.where("label is not null").repartition(id_col), "perceptron-rows")
    labels = [r["label"] for r in prepared.select("label").distinct().orderBy("label").collect()]
    if not labels:
        raise ValueError("No labelled rows to train on.")
    apart = F.pmod(F.xxhash64(F.lit(seed + 2), F.col(id_col)), F.lit(10_000)) < round(validation_share * 10_000)
    features = fit_features(prepared.where(~apart), id_col, blocks)
    y = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")) - 1
    vectors = features.transform(prepared).select(
        F.col(id_col).alias("id"), y.cast("int").alias("y"), "features", apart.alias("apart")
    )
    vectors = materialise(vectors, "perceptron-vectors")
    width = vectors.first()["features"].size
    training = train_on_vectors(vectors.where("not apart"), vectors.where("apart"), labels, width, seed=seed, **options)
    return FileClassifier(features, training)


def perceptron_scorer(classifier: FileClassifier) -> Scorer:
    """Scorer over (filepath, content): one pass, batches travel as Arrow."""
    spark = SparkSession.active()
    shared = spark.sparkContext.broadcast(classifier.training.model)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def probabilities(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            found = [shared.value.forward(x, used)[-1] for _, x, used in blocks_of_rows(vectors)]
            flat = np.concatenate(found).astype(np.float64) if found else np.zeros((0, len(shared.value.labels)))
            borders = np.arange(len(flat) + 1, dtype=np.int32) * len(shared.value.labels)
            yield pa.ListArray.from_arrays(pa.array(borders), pa.array(flat.ravel()))

    return scorer_of(classifier.features, probabilities(F.col("features")), classifier.labels)


# --- storage ------------------------------------------------------------------------------------------


def save_perceptron(spark: SparkSession, model: Perceptron, path: str) -> None:
    """One row per block of weights, written whole or not at all."""
    parts = [model.flat[at : at + BLOCK].astype("<f4").tobytes() for at in range(0, len(model.flat), BLOCK)]
    rows = [(i, part, model.labels, list(model.widths)) for i, part in enumerate(parts)]
    schema = "block int, part binary, labels array<string>, widths array<int>"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def load_perceptron(spark: SparkSession, path: str) -> Perceptron:
    rows = spark.read.parquet(path).orderBy("block").collect()
    flat = np.concatenate([np.frombuffer(bytes(r["part"]), "<f4") for r in rows])
    return Perceptron(list(rows[0]["labels"]), tuple(rows[0]["widths"]), flat)


def save_classifier(classifier: FileClassifier, path: str) -> None:
    training = classifier.training
    classifier.features.write().overwrite().save(f"{path}/features")
    training.history.withColumn("best_epoch", F.lit(training.best_epoch).cast("int")).write.mode("overwrite").parquet(f"{path}/history")
    save_perceptron(training.history.sparkSession, training.model, f"{path}/weights")


def load_classifier(spark: SparkSession, path: str) -> FileClassifier:
    history = spark.read.parquet(f"{path}/history")
    ends = history.agg(F.max("best_epoch").alias("best"), F.max("epoch").alias("last")).first()
    training = Training(load_perceptron(spark, f"{path}/weights"), history.drop("best_epoch"), ends["best"], ends["last"])
    return FileClassifier(PipelineModel.load(f"{path}/features"), training)
