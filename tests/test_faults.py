"""Nulls, NaN, zeros, blanks and damaged files."""

from __future__ import annotations

import math
import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sortflow.functions.text import normalize_value
from sortflow.operators import evaluate as ev
from sortflow.operators.corpus import load_sources, sample_per_source, source_audit, stratified_cap, stratified_split
from sortflow.operators.movelog import read_log
from sortflow.sources import files
from sortflow.sources.manifest import LOCAL, Manifest
from sortflow.sources.tables import load_corpus, write_corpus


def half_null(spark, n=20):
    return spark.createDataFrame([(i, None if i % 2 else "a") for i in range(n)], "id long, source string")


def test_null_is_a_source_and_a_label(spark):
    rows = half_null(spark)
    assert sample_per_source(rows, "source", "id", 100).count() == 20
    assert sample_per_source(rows, "source", "id", 3).groupBy("source").count().collect() == [("a", 3), (None, 3)] or {
        r["source"]: r["count"] for r in sample_per_source(rows, "source", "id", 3).groupBy("source").count().collect()
    } == {"a": 3, None: 3}
    split = stratified_split(rows, "source", "id")
    assert {(r["source"], r["count"]) for r in split.where("split = 'validation'").groupBy("source").count().collect()} == {("a", 2), (None, 2)}
    assert stratified_cap(rows, "source", "id", 16).count() == 16


def test_zero_probability_is_an_infinite_loss(spark):
    rows = spark.createDataFrame([(0, 0.0), (1, 0.5), (2, 1.0)], "id long, p_true double")
    loss = ev.mean_loss(rows, "id", 2).first()
    assert loss["mean_row_loss"] == math.inf and loss["mean_batch_loss"] == math.inf
    missing = spark.createDataFrame([(0, None), (1, 0.5)], "id long, p_true double")
    assert math.isnan(ev.mean_loss(missing, "id", 2).first()["mean_row_loss"])


def test_nan_never_improves(spark):
    rows = spark.createDataFrame([("r", i + 1, x) for i, x in enumerate([0.5, float("nan"), 0.9, 0.8])], "run string, epoch int, m double")
    stop = ev.early_stop(rows, "run", "epoch", "m", patience=3).first()
    assert (stop["best_epoch"], stop["best_metric"], stop["last_epoch"]) == (3, 0.9, 4)


def test_a_file_predicted_twice_is_seen(spark):
    expected = spark.createDataFrame([(1, "A", True), (2, "B", True)], "k long, expected string, stable boolean")
    twice = spark.createDataFrame([(1, "A", 0.9), (1, "A", 0.9)], "k long, category string, confidence double")
    check = ev.prediction_checks(twice, expected, "k", 0, 0).first()
    assert (check["files_tested"], check["records"], check["ok"]) == (2, 2, False)
    right = spark.createDataFrame([(1, "A", 0.9), (2, "A", 0.9)], "k long, category string, confidence double")
    assert ev.prediction_checks(right, expected, "k", 1, 1).first()["ok"]


def test_no_label_vanishes_from_the_matrix(spark):
    rows = spark.createDataFrame([("a", "a"), ("Z", "a"), ("a", "Other")], "y_true string, y_pred string")
    assert [r["true_label"] for r in ev.confusion_matrix(rows).collect()] == ["Other", "Z", "a"]
    with pytest.raises(ValueError, match="Other"):
        ev.confusion_matrix(rows, ["a", "Z"])


def test_text_of_doubles(spark):
    r = random.Random(1)
    values = [0.00012345678901234567, 2.5e-05, 1e16, 1e-4, 123456789.0, 5e-324, 1.7976931348623157e308, 2e23, 9007199254740993.0, 0.1, -1.5, 1e22]
    values += [struct.unpack("d", struct.pack("Q", r.getrandbits(64)))[0] for _ in range(3000)] + [r.uniform(-1000, 1000) for _ in range(500)]
    values = [v for v in values if v == v and v not in (0.0, math.inf, -math.inf)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = [x[0] for x in df.select(normalize_value(F.col("v"), T.DoubleType())).collect()]
    assert found == [repr(v) for v in values]


def test_outer_blanks_and_names_that_look_like_numbers(spark, tmp_path):
    rows = spark.createDataFrame([("001", "  lead and trail  ", "x"), ("1e5", "two\nlines", "y")], "filename string, content string, label string")
    write_corpus(rows, str(tmp_path / "c.csv"), "csv")
    back = {(r["filename"], r["content"]) for r in load_corpus(spark, str(tmp_path / "c.csv"), "csv").collect()}
    assert back == {("001", "  lead and trail  "), ("1e5", "two\nlines")}


def test_a_damaged_optional_source_is_audited(spark, tmp_path):
    """A file that is no parquet, and one whose footer is sound and whose pages are not."""
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 no parquet at all")
    rows = [(f"{i}.txt", f"some words of text number {i}") for i in range(500)]
    spark.createDataFrame(rows, "filename string, text string").coalesce(1).write.parquet(f"{tmp_path}/pages")
    page = next((tmp_path / "pages").glob("*.parquet"))
    data = bytearray(page.read_bytes())
    data[60:2_000] = bytes(1_940)
    page.write_bytes(bytes(data))
    next((tmp_path / "pages").glob(f".{page.name}.crc")).unlink()
    for name in ("bad.parquet", "pages", "absent"):
        entry = {"path": str(tmp_path / name), "format": "parquet", "label": "Docs", "content_columns": ["text"]}
        loads = load_sources(spark, Manifest.from_dict({"sources": [entry]}))
        assert loads[0].rows is None and len(loads[0].error) > 20 and source_audit(spark, loads).first()["status"] == "skipped"


def test_only_a_missing_log_is_empty(spark, tmp_path):
    assert read_log(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "log").write_text("no folder and no parquet")
    with pytest.raises(Exception):  # noqa: B017
        read_log(spark, str(tmp_path / "log")).count()


def test_heads_of_files_of_any_size(spark, tmp_path):
    with open(tmp_path / "large.txt", "wb") as f:
        f.write("  é\r\n".encode() + b"\xff" * 5_000 + b"x" * 600)
        f.truncate(2 << 30)  # a sparse file
    (tmp_path / "_draft.md").write_text("draft")
    (tmp_path / "a b%20.txt").write_text("")
    (tmp_path / "gone.txt").symlink_to(tmp_path / "nowhere")
    (tmp_path / "data.bin").write_text("data")
    got = {r["filename"]: r["content"] for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got.pop("gone.txt", "") == ""
    assert got == {"large.txt": "é\n" + "x" * 496, "_draft.md": "draft", "a b%20.txt": "", "data.bin": ""}
    (tmp_path / "empty").mkdir()
    assert files.read_files(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(Exception, match="nothing"):
        files.read_files(spark, str(tmp_path / "nothing")).count()



def python_text(x) -> str:
    """What the rule says: falsy values are empty, other numbers are their shortest text."""
    return "" if not x else repr(x)


def odd_doubles(n: int = 3_000) -> list:
    r = random.Random(8)
    made = [struct.unpack("<d", r.getrandbits(64).to_bytes(8, "little"))[0] for _ in range(n)]
    made += [r.uniform(-1e6, 1e6) for _ in range(n)] + [round(r.uniform(0, 1e5), r.randrange(6)) for _ in range(n)]
    return [None, 0.0, -0.0, math.nan, math.inf, -math.inf, 5e-324, 1e16, 1e-5, 123456789.0, *made]


def test_doubles_and_nulls_as_text(spark):
    values = odd_doubles()
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i long, x double")
    got = dict(rows.select("i", normalize_value(F.col("x"), T.DoubleType())).collect())
    assert [got[i] for i in range(len(values))] == [python_text(x) for x in values]


def test_arrays_of_doubles_and_nulls_as_text(spark):
    values, r = odd_doubles(200), random.Random(9)
    lists = [None, [], [None], [0.0, None], *[[r.choice(values) for _ in range(r.randrange(5))] for _ in range(200)]]
    kind = T.ArrayType(T.DoubleType())
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], T.StructType([T.StructField("i", T.LongType()), T.StructField("x", kind)]))
    got = dict(rows.select("i", normalize_value(F.col("x"), kind)).collect())
    assert [got[i] for i in range(len(lists))] == [" ".join(t for t in map(python_text, x or []) if t) for x in lists]


def test_a_null_number_is_no_reason_to_lose_a_source(spark, tmp_path):
    spark.createDataFrame([("a.txt", 1.5), ("b.txt", None)], "filename string, content double").write.parquet(f"{tmp_path}/numbers")
    entry = {"path": f"{tmp_path}/numbers", "format": "parquet", "label": "Code", "content_columns": ["content"], "min_content_length": 0}
    load = load_sources(spark, Manifest.from_dict({"sources": [entry]}))[0]
    assert load.error is None and "1.5" in {r.content for r in load.rows.collect()}


def test_a_failing_job_ends_the_build(spark, tmp_path):
    """Only what cannot be read is skipped; other failures are not taken for bad sources."""
    spark.createDataFrame([("a.txt", "text")], "filename string, content string").write.parquet(f"{tmp_path}/good")
    entry = {"path": f"{tmp_path}/good", "format": "parquet", "label": "Code", "content_columns": ["content"]}

    def fails_in_the_job(spark, spec):
        return spark.read.parquet(spec.path).withColumn("content", F.raise_error(F.lit("a bug")).cast("string"))

    with pytest.raises(Exception, match="a bug"):
        load_sources(spark, Manifest.from_dict({"sources": [entry]}), {LOCAL: fails_in_the_job})
