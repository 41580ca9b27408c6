from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sortflow.operators import classify as ops
from sortflow.operators.features import Block
from sortflow.workload.classify_queries import centroid_model

# name, rule category
RULED = [
    ("api_router.py", "Code"), ("meeting_protocol.txt", None), ("invoice_march_2026.txt", None),
    ("lecture_backprop.txt", None), ("server_worker.log", "Logs"), ("unsorted_blob.tmp", None),
    ("promo_banner.jpg", "Media"), ("backup_snapshot.zip", "Archives"), ("api_client.py", "Code"),
    ("service.log", "Logs"), ("family_photo.jpg", "Media"), ("backup_weekly.zip", "Archives"),
    ("a.zip.py", "Archives"), ("a.py.jpg", "Media"), ("x.TAR.GZ", "Archives"), (".py", None), ("x.py.", None),
    ("dir.py/readme", None), ("/in/script.log.sh", "Code"),
]


def files(spark):
    return spark.createDataFrame([(n, f"  text of {n} ") for n, _ in RULED], "filepath string, content string")


def test_rules(spark):
    got = {r.filepath: r for r in ops.classify_by_rule(files(spark)).collect()}
    assert {n: r.category for n, r in got.items()} == {n: c for n, c in RULED if c}
    assert got["api_router.py"].confidence == 0.98 and got["promo_banner.jpg"].confidence == 0.99
    assert all(r.content_preview == "" for r in got.values())
    assert got["/in/script.log.sh"].filename == "script.log.sh"


def constant_scorer(category, confidence):
    def score(df):
        return df.withColumn("category", F.lit(category)).withColumn("confidence", F.lit(confidence).cast("double"))

    return score


@pytest.mark.parametrize(
    ("confidence", "category", "shown"),
    [(0.9, "Docs", 0.9), (0.5497, "Other", 0.55), (0.55, "Docs", 0.55), (None, "Other", 0.0), (float("nan"), "Other", 0.0)],
)
def test_fallback_reject_and_fail_soft(spark, confidence, category, shown):
    split = ops.classify(files(spark), constant_scorer("Docs", confidence)).collect()
    in_place = ops.classify_in_place(files(spark), F.lit("Docs"), F.lit(confidence).cast("double")).collect()
    assert sorted(split) == sorted(in_place) and len(split) == len(RULED)
    for r in split:
        if not dict(RULED)[r.filepath]:
            failed = shown == 0.0
            assert (r.category, r.confidence) == (category, shown)
            assert r.content_preview == ("" if failed else f"text of {r.filepath}")


def test_only_undecided_rows_are_scored(spark):
    seen = []

    def score(df):
        seen.append(df.count())
        return constant_scorer("Docs", 0.7)(df)

    ops.classify(files(spark), score).count()
    assert seen == [sum(c is None for _, c in RULED)]


def test_softmax(spark):
    logits = [[1.0, 2.0, 3.0], [1000.0, 0.0, 1000.0], [-5.0, -5.0, -6.0]]
    df = spark.createDataFrame([(x,) for x in logits], "z array<double>")
    for r in ops.softmax_prediction(df, "z", ["a", "b", "c"]).collect():
        e = np.exp(np.array(r.z) - max(r.z))
        p = e / e.sum()
        assert r.category == "abc"[int(p.argmax())]
        assert r.confidence == pytest.approx(p.max())
        assert [r.probabilities[k] for k in "abc"] == pytest.approx(list(p))
    unknown = ops.softmax_prediction(df.limit(1), "z", ["a", "b", "c"]).first()
    assert set(unknown.probabilities) == {"a", "b", "c"}


def test_external_model_runs_in_batches(spark):
    centroids = np.eye(3)
    rows = [(i, [float(i % 3 == k) * 4 for k in range(3)]) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, v array<float>").repartition(3)
    score = ops.external_scorer(centroid_model(centroids), "v", 3, ["x", "y", "z"], batch_size=7)
    got = {r.id: r for r in score(df).collect()}
    e = np.exp([4.0, 0.0, 0.0])
    assert all(got[i].category == "xyz"[i % 3] for i in range(30))
    assert got[0].confidence == pytest.approx(e[0] / e.sum(), abs=1e-6)


@pytest.fixture(scope="module")
def topics(spark):
    text = {
        "Docs": "meeting notes about the release plan and the owners",
        "Finance": "invoice amount due payment tax and budget total",
        "Study": "lecture on gradients matrices and exam theory",
    }
    rows = [(i, f"{label.lower()}_{i}.txt", f"{text[label]} number {i}", label) for i in range(45) for label in [list(text)[i % 3]]]
    return spark.createDataFrame(rows, "id bigint, filename string, content string, label string")


BLOCKS = (Block("n", "filename", "char", 2, 4, 50), Block("w", "content", "word", 1, 2, 60))


@pytest.mark.parametrize("algorithm", ["mlp", "logistic"])
def test_train_save_load_score(spark, topics, tmp_path, algorithm):
    model = ops.train_classifier(
        topics, "id", BLOCKS, hidden=(8, 4), max_iter=40, selected_features=30, algorithm=algorithm
    )
    ops.save_model(model, str(tmp_path / "model"))
    loaded = ops.load_model(str(tmp_path / "model"))
    assert ops.model_labels(loaded) == ["Docs", "Finance", "Study"]
    inputs = topics.select("id", F.col("filename").alias("filepath"), "filename", "content", "label")
    got = ops.model_scorer(loaded)(inputs).collect()
    assert sum(r.category == r.label for r in got) >= 43
    assert all(r.confidence == max(r.probabilities) and sum(r.probabilities) == pytest.approx(1) for r in got)
    assert all(r.filename == r.filepath for r in got)
    record = ops.classify(inputs, ops.model_scorer(loaded), keep=["id"])
    assert record.columns == ["id", *ops.PREDICTION_COLUMNS] and record.count() == 45
    with pytest.raises(ValueError, match="Unknown algorithm"):
        ops.train_classifier(topics, "id", BLOCKS, algorithm="x")
