from __future__ import annotations

import math
import random

import pytest

from sortflow.operators import evaluate as ops

LABELS = ["Archives", "Code", "Docs", "Finance", "Logs", "Media", "Other", "Study"]

# Published confusion matrices (rows are truths, in label order) and figures of their reports.
GOLDEN = {
    "tfidf": (
        [
            [120, 0, 0, 0, 0, 0, 0, 0], [0, 200, 0, 0, 0, 0, 0, 0], [0, 0, 190, 10, 0, 0, 0, 0],
            [0, 0, 3, 156, 0, 0, 0, 1], [0, 0, 0, 0, 197, 0, 0, 0], [0, 0, 0, 0, 0, 120, 0, 0],
            [0, 0, 0, 0, 0, 0, 120, 0], [0, 0, 2, 0, 0, 0, 0, 178],
        ],
        {
            "Docs": (0.9743589743589743, 0.95, 0.9620253164556962, 200.0),
            "Finance": (0.9397590361445783, 0.975, 0.9570552147239264, 160.0),
            "Study": (0.994413407821229, 0.9888888888888889, 0.9916434540389972, 180.0),
            "accuracy": (0.9876638396299152,) * 4,
            "macro avg": (0.9885664272905977, 0.9892361111111111, 0.9888404981523276, 1297.0),
            "weighted avg": (0.9878393631941007, 0.9876638396299152, 0.9876867535651404, 1297.0),
        },
    ),
    "four empty columns": (
        [
            [0, 69, 0, 0, 0, 0, 0, 0], [0, 115, 0, 0, 0, 0, 0, 0], [0, 0, 97, 0, 13, 0, 0, 28],
            [0, 0, 60, 0, 2, 0, 0, 37], [0, 8, 0, 0, 107, 0, 0, 0], [0, 51, 18, 0, 0, 0, 0, 0],
            [0, 47, 22, 0, 0, 0, 0, 0], [0, 0, 37, 0, 5, 0, 0, 84],
        ],
        {
            "Archives": (0.0, 0.0, 0.0, 69.0),
            "Code": (0.39655172413793105, 1.0, 0.5679012345679012, 115.0),
            "Logs": (0.84251968503937, 0.9304347826086956, 0.8842975206611571, 115.0),
            "accuracy": (0.50375,) * 4,
            "macro avg": (0.27716996412112005, 0.4125, 0.3230766528102794, 800.0),
            "weighted avg": (0.33841487163437217, 0.50375, 0.3949314303017138, 800.0),
        },
    ),
    "small transformer": (
        [
            [120, 0, 0, 0, 0, 0, 0, 0], [0, 200, 0, 0, 0, 0, 0, 0], [0, 0, 238, 2, 0, 0, 0, 0],
            [0, 0, 2, 170, 0, 0, 0, 0], [0, 0, 0, 0, 200, 0, 0, 0], [0, 0, 0, 0, 0, 120, 0, 0],
            [0, 0, 0, 0, 0, 0, 120, 0], [0, 0, 18, 0, 0, 0, 0, 200],
        ],
        {
            "Docs": (0.9224806201550387, 0.9916666666666667, 0.9558232931726908, 240.0),
            "Study": (1.0, 0.9174311926605505, 0.9569377990430622, 218.0),
            "accuracy": (0.9841726618705036,) * 4,
            "macro avg": (0.9888565891472868, 0.9871837440438092, 0.9876416481548761, 1390.0),
            "weighted avg": (0.985176509954827, 0.9841726618705036, 0.9841798780955635, 1390.0),
        },
    ),
}


def predictions(spark, matrix):
    pairs = [
        (LABELS[i], LABELS[j]) for i, row in enumerate(matrix) for j, n in enumerate(row) for _ in range(n)
    ]
    return spark.createDataFrame(pairs, "y_true string, y_pred string")


@pytest.mark.parametrize("run", GOLDEN)
def test_reports_match_published_runs(spark, run):
    matrix, expected = GOLDEN[run]
    df = predictions(spark, matrix)
    report = {r.label: tuple(r)[1:] for r in ops.class_report_full(df).collect()}
    assert len(report) == len(LABELS) + 3
    for label, values in expected.items():
        assert report[label] == pytest.approx(values, abs=1e-12)
    cells = [list(r)[1:] for r in ops.confusion_matrix(df, LABELS).collect()]
    assert cells == matrix
    one = ops.summary(df).first()
    total, hits = sum(map(sum, matrix)), sum(matrix[i][i] for i in range(8))
    assert (one.rows, one.total_errors, one.accuracy) == (total, total - hits, round(hits / total, 6))


def test_matrix_keeps_labels_without_rows(spark):
    df = spark.createDataFrame([("a", "b")], "y_true string, y_pred string")
    assert [tuple(r) for r in ops.confusion_matrix(df, ["a", "b", "c"]).collect()] == [
        ("a", 0, 1, 0), ("b", 0, 0, 0), ("c", 0, 0, 0),
    ]


def test_top_errors_order_and_limit(spark):
    rows = [(i, f"f{i}", "x\ny" * 100, "a", "b" if i % 2 else "a", 0.5 + (i % 3) / 10, 0.1) for i in range(40)]
    df = spark.createDataFrame(
        rows, "row_index int, filename string, content string, y_true string, y_pred string, p_pred double, p_true double"
    )
    got = ops.top_errors(df, 7).collect()
    wrong = sorted((r for r in rows if r[3] != r[4]), key=lambda r: (-round(r[5], 6), r[0]))
    assert [r.row_index for r in got] == [r[0] for r in wrong[:7]]
    assert got[0].margin_pred_minus_true == 0.6 and len(got[0].content_preview) == 220
    assert ops.top_errors(df, 0).count() == 0


def test_mean_loss_is_a_mean_of_batches(spark, small_chunks):
    p = [0.9, 0.8, 0.7, 0.6, 0.5]
    df = spark.createDataFrame(list(enumerate(p)), "id bigint, p_true double")
    losses = [-math.log(x) for x in p]
    row = ops.mean_loss(df, "id", 2).first()
    batches = [sum(losses[:2]) / 2, sum(losses[2:4]) / 2, losses[4]]
    assert row.mean_batch_loss == pytest.approx(sum(batches) / 3)
    assert row.mean_row_loss == pytest.approx(sum(losses) / 5)
    assert row.batches == 3


def test_comparison_and_gate(spark):
    report = "label string, precision double, recall double, f1_score double, support double"
    base = spark.createDataFrame(
        [("accuracy", 0.9, 0.9, 0.9, 0.9), ("macro avg", 0.8, 0.8, 0.8, 9.0), ("weighted avg", 0.8, 0.8, 0.8, 9.0), ("Docs", 0.5, 0.5, 0.5, 4.0)],
        report,
    )
    cand = spark.createDataFrame(
        [("accuracy", 0.95, 0.95, 0.95, 0.95), ("macro avg", 0.798, 0.8, 0.798, 9.0), ("weighted avg", 0.9, 0.9, 0.9, 9.0), ("Docs", 0.6, 0.6, 0.6, 4.0)],
        report,
    )
    lines = ops.compare_runs(base, cand, ["Docs", "Study"]).collect()
    texts = {(r.label, r.metric): r.delta_text for r in lines}
    assert len(lines) == 1 + 4 * 3
    assert texts["accuracy", "accuracy"] == "+0.0500"
    assert texts["macro avg", "f1_score"] == "-0.0020"
    assert texts["Study", "recall"] == "n/a"
    compared = ops.compare_runs(base, cand, ["Docs"])
    assert tuple(ops.acceptance_gate(compared, ["Docs"]).first()) == (True, True, True, True)
    assert tuple(ops.acceptance_gate(compared, ["Docs"], tolerance=0.001).first()) == (False, True, True, False)
    missing = ops.compare_runs(base, cand, ["Study"])
    assert ops.acceptance_gate(missing, ["Study"]).first().focus_ok is False


def naive_early_stop(metrics, patience):
    best, since, best_epoch, last = -1.0, 0, None, 0
    for epoch, value in enumerate(metrics, 1):
        last = epoch
        if value > best:
            best, since, best_epoch = value, 0, epoch
        else:
            since += 1
            if since >= patience:
                return best_epoch, last, best, True
    return best_epoch, last, best, False


@pytest.mark.parametrize("patience", [1, 2, 4])
def test_early_stop_equals_the_loop(spark, small_chunks, patience):
    rng = random.Random(patience)
    runs = {k: [round(rng.random(), 1) for _ in range(rng.randint(1, 15))] for k in range(25)}
    runs[99] = [-2.0, -1.0, -3.0, 0.5]
    rows = [(k, e, m) for k, ms in runs.items() for e, m in enumerate(ms, 1)]
    df = spark.createDataFrame(rows, "run int, epoch int, m double")
    stops = ops.early_stop(df, "run", "epoch", "m", patience)
    for r in stops.collect():
        best_epoch, last, best, stopped = naive_early_stop(runs[r.run], patience)
        assert (r.best_epoch, r.last_epoch, r.stopped_early) == (best_epoch, last, stopped)
        assert r.best_metric == (best if best_epoch else r.best_metric)
    saved = ops.saved_history(df, stops, "run", "epoch").groupBy("run").count().collect()
    assert {r.run: r["count"] for r in saved} == {
        k: naive_early_stop(ms, patience)[0] for k, ms in runs.items() if naive_early_stop(ms, patience)[0]
    }


def test_prediction_checks(spark):
    got = spark.createDataFrame(
        [("a.py", "Code", 0.98), ("b.txt", "Docs", 0.7), ("c.txt", "Other", 0.2)], "filename string, category string, confidence double"
    )
    expected = spark.createDataFrame(
        [("a.py", "Code", True), ("b.txt", "Docs", False), ("c.txt", "Study", False)], "filename string, expected string, stable boolean"
    )
    row = ops.prediction_checks(got, expected, "filename", 2, 1).first()
    assert (row.files_tested, row.matched_expected, row.stable_matched, row.categories, row.ok) == (3, 2, 1, "Code,Docs,Other", True)
    assert not ops.prediction_checks(got, expected, "filename", 3, 1).first().ok
    assert not ops.prediction_checks(got.where("filename <> 'a.py'"), expected, "filename", 1, 0).first().ok


def test_artifacts_are_written(spark, tmp_path):
    df = spark.createDataFrame([("a", "b"), ("a", "a")], "y_true string, y_pred string")
    ops.save_artifacts(df, ["a", "b"], str(tmp_path))
    back = spark.read.csv(f"{tmp_path}/classification_report.csv", header=True, inferSchema=True)
    assert {r.label for r in back.collect()} == {"a", "b", "accuracy", "macro avg", "weighted avg"}
    assert spark.read.json(f"{tmp_path}/summary.json").first().total_errors == 1
