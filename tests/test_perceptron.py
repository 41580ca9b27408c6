from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sortflow.operators import perceptron as ops
from sortflow.operators.classify import classify
from sortflow.operators.evaluate import early_stop
from sortflow.operators.features import Block
from sortflow.workload import classify_queries

WIDTH, LABELS = 12, ["a", "b", "c"]


def made(n=260, seed=5):
    """(id, y, cells); the label depends on which features stand together, never on one alone."""
    r, rows = np.random.default_rng(seed), []
    for i in range(n):
        v = np.where(r.random(WIDTH) < 0.5, 0.5 + r.random(WIDTH), 0.0)
        rows.append((i, 2 if v[2] and v[3] else int(bool(v[0]) ^ bool(v[1])), v))
    return rows


def frame(spark, rows):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("features", VectorUDT())])
    at = lambda v: [int(k) for k in np.flatnonzero(v)]
    vectors = [Vectors.dense(v) if i % 5 == 0 else Vectors.sparse(WIDTH, at(v), v[at(v)]) for i, (_, _, v) in enumerate(rows)]
    return spark.createDataFrame([(i, y, x) for (i, y, _), x in zip(rows, vectors)], schema)


def plain_outputs(params, x):
    outs = [x]
    for i, (w, b) in enumerate(params):
        z = outs[-1] @ w + b
        outs.append(np.maximum(z, 0) if i < len(params) - 1 else np.exp(z) / np.exp(z).sum(axis=1, keepdims=True))
    return outs


def plain_training(batches, params, epochs, order, rate):
    """A textbook loop in doubles over whole matrices."""
    m = [[np.zeros_like(p) for p in layer] for layer in params]
    s = [[np.zeros_like(p) for p in layer] for layer in params]
    t = 0
    for _ in range(epochs):
        for step in order.permutation(len(batches)):
            x, y = batches[step]
            outs = plain_outputs(params, x)
            delta = (outs[-1] - np.eye(len(LABELS))[y]) / len(y)
            grads = []
            for i in range(len(params) - 1, -1, -1):
                grads.append((outs[i].T @ delta + ops.DECAY / len(y) * params[i][0], delta.sum(axis=0) + ops.DECAY / len(y) * params[i][1]))
                delta = (delta @ params[i][0].T) * (outs[i] > 0)
            t += 1
            for layer, mean, square, grad in zip(params, m, s, reversed(grads)):
                for k in (0, 1):
                    mean[k] = 0.9 * mean[k] + 0.1 * grad[k]
                    square[k] = 0.999 * square[k] + 0.001 * grad[k] ** 2
                    layer[k] -= rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * mean[k] / (np.sqrt(square[k]) + 1e-8)
    return params


@pytest.mark.parametrize(("block", "fan_in", "task_rows"), [(ops.BLOCK, ops.FAN_IN, ops.TASK_ROWS), (17, 2, 9)])
def test_training_equals_a_plain_loop(spark, monkeypatch, block, fan_in, task_rows):
    """Whatever the blocks, the levels of the tree and the tasks are."""
    monkeypatch.setattr(ops, "BLOCK", block)
    monkeypatch.setattr(ops, "FAN_IN", fan_in)
    monkeypatch.setattr(ops, "TASK_ROWS", task_rows)
    rows, epochs, size, rate = made(), 3, 70, 0.01
    train = frame(spark, rows)
    trained = ops.train_on_vectors(
        train, train.limit(0), LABELS, WIDTH, hidden=(6, 5), max_epochs=epochs, patience=99, batch_rows=size, rate=rate, seed=3
    )
    steps = -(-len(rows) // size)
    batch_of = {r.id: r.b for r in train.select("id", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(steps)).alias("b")).collect()}
    batches = []
    for b in range(steps):
        own = [(y, v) for i, y, v in rows if batch_of[i] == b]
        batches.append((np.array([v for _, v in own]), np.array([y for y, _ in own])))
    start = ops.Perceptron.fresh(LABELS, (WIDTH, 6, 5, 3), 3)
    params = [[w.astype(float).copy(), b.astype(float).copy()] for w, b in start.layers()]
    wanted = plain_training(batches, params, epochs, np.random.default_rng(3), rate)
    for (w, b), (pw, pb) in zip(trained.model.layers(), wanted):
        assert np.allclose(w, pw, atol=2e-4) and np.allclose(b, pb, atol=2e-4)
    assert trained.best_epoch is None and trained.last_epoch == epochs and trained.history.count() == epochs


def test_interactions_are_learnt_and_the_stop_is_that_of_the_scan(spark, tmp_path):
    train, validation = frame(spark, made(600)), frame(spark, made(200, seed=6))
    trained = ops.train_on_vectors(
        train, validation, LABELS, WIDTH, hidden=(32, 16), patience=6, batch_rows=300, rate=0.03, keep_in=str(tmp_path), run="r"
    )
    stop = early_stop(trained.history, "run", "epoch", "val_macro_f1", patience=6).first()
    assert (stop.best_epoch, stop.last_epoch) == (trained.best_epoch, trained.last_epoch)
    matrix = ops.confusion(validation, trained.model)
    assert ops.macro_f1(matrix) == pytest.approx(stop.best_metric) and np.trace(matrix) / matrix.sum() > 0.9
    kept = ops.load_perceptron(spark, f"{tmp_path}/epoch-{trained.best_epoch}")
    assert np.array_equal(kept.flat, trained.model.flat) and kept.widths == (WIDTH, 32, 16, 3)


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def test_shuffles_of_a_step_do_not_stay(spark, monkeypatch):
    inside, seen = ops.summed_gradient, []

    def summed(rows, model, tasks):
        seen.append(shuffle_files(spark))
        return inside(rows, model, max(tasks, 2))

    monkeypatch.setattr(ops, "summed_gradient", summed)
    train = frame(spark, made(40))
    ops.train_on_vectors(train, train.limit(0), LABELS, WIDTH, hidden=(3,), max_epochs=4, patience=99, batch_rows=40)
    until = time.time() + 20
    while (left := shuffle_files(spark) - seen[0]) and time.time() < until:
        time.sleep(0.2)
    assert not left and len(seen) == 4


def test_nothing_to_learn_and_one_label(spark):
    empty = frame(spark, [])
    with pytest.raises(ValueError, match="No labelled rows"):
        ops.train_on_vectors(empty, empty, LABELS, WIDTH)
    rows = [(None, 0, np.ones(WIDTH))] * 5 + [(1, 0, np.zeros(WIDTH))]
    same = ops.train_on_vectors(frame(spark, rows), frame(spark, rows), ["a"], WIDTH, hidden=(3,), patience=2)
    assert ops.confusion(frame(spark, rows), same.model).tolist() == [[6]] and same.best_epoch == 1 and same.last_epoch == 3


BLOCKS = (Block("n", "filename", "char", 2, 4, 50), Block("w", "content", "word", 1, 2, 60))


def test_classifier_of_files(spark, tmp_path):
    text = {"Docs": "meeting notes about the release plan", "Finance": "invoice amount due tax", "Study": "lecture on gradients"}
    names = list(text)
    rows = [(i, f"{names[i % 3].lower()}_{i}.txt", f"{text[names[i % 3]]} number {i}", names[i % 3], "x") for i in range(60)]
    rows += [(60, "none.txt", None, None, "x"), (61, "", "", "Docs", "x"), (61, "", "", "Docs", "x"), (62, None, None, "Docs", "x")]
    corpus = spark.createDataFrame(rows, "id bigint, filename string, content string, label string, features string")
    made = ops.train_perceptron(corpus, "id", BLOCKS, hidden=(16, 8), max_epochs=60, rate=0.02)
    assert made.labels == names and 1 <= made.training.best_epoch <= made.training.last_epoch
    ops.save_classifier(made, str(tmp_path / "model"))
    loaded = ops.load_classifier(spark, str(tmp_path / "model"))
    assert (loaded.training.best_epoch, loaded.training.last_epoch) == (made.training.best_epoch, made.training.last_epoch)
    inputs = corpus.where("id < 61").select("id", F.col("filename").alias("filepath"), "filename", "content", "label")
    got = ops.perceptron_scorer(loaded)(inputs).collect()
    assert sum(r.category == r.label for r in got) >= 57 and len(got) == 61
    assert all(r.confidence == max(r.probabilities) and sum(r.probabilities) == pytest.approx(1, abs=1e-5) for r in got)
    assert classify(inputs, ops.perceptron_scorer(loaded), keep=["id"]).count() == 61


def test_the_query_learns_from_every_training_row(spark, monkeypatch, tmp_path):
    """Also where there are more than the logistic model is given."""
    rows = [(i, "web", ["en", "de", "fr"][i % 3], f"text {i}") for i in range(90)]
    spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    monkeypatch.setattr(classify_queries, "MAX_LABELLED_ROWS", 20)
    monkeypatch.setattr(classify_queries, "_perceptrons", {})
    monkeypatch.setattr(ops, "train_perceptron", lambda corpus, id_col: seen.extend(r[id_col] for r in corpus.collect()))
    classify_queries.trained_perceptron(spark, str(tmp_path))
    wanted = classify_queries.split_corpus(spark, str(tmp_path)).where("split = 'train'").collect()
    assert len(wanted) == 72 and sorted(seen) == sorted(r.doc_id for r in wanted)
