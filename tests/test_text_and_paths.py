from __future__ import annotations

from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from sortflow.functions import paths, text
from sortflow.functions.labels import category_icon, confidence_band

WHITESPACE = [chr(c) for c in range(0x110000) if chr(c).isspace()]

# Awkward names; expected values follow from PurePosixPath.
NAMES = [
    "Invoice_April-15.PDF", "a.tar.gz", ".env", "prod.env", "foo.", "..x.txt", "https://x.y/z/page.html",
    "fed cuts 0.25 pct", "noext", "", "a/b/", "x.py.jpg", ".hidden.tar.gz", "a..b", "a.b.", "src/mod/func.py",
    "a/./", ".", "trailing.txt\n",
]


def has_fixed_suffix_rule() -> bool:
    """Later Python versions take a trailing dot for a suffix; the rule here is the older one."""
    return PurePosixPath("foo.").suffix == ""


def one_column(spark, values, dtype="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")


def evaluate(spark, values, expression, dtype="string"):
    df = one_column(spark, values, dtype)
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def python_featurize(name):
    path = PurePosixPath(name.lower())
    words = path.stem.replace("_", " ").replace("-", " ")
    ext = path.suffix.lstrip(".")
    return f"{words} EXT_{ext}" if ext else words


def test_whitespace_is_the_python_set(spark):
    assert len(WHITESPACE) == 29
    values = [f"a{w}{w}b{w}" for w in WHITESPACE] + ["a b", " a\x00b ", "", None, "a \n b  c"]
    expected = [" ".join((v or "").replace("\x00", " ").split()) for v in values]
    assert evaluate(spark, values, text.normalize_text) == expected
    collapsed = [" ".join((v or "").split()) for v in values]
    assert evaluate(spark, values, text.collapse_whitespace) == collapsed


def test_strip_takes_every_python_blank(spark):
    values = [f"{w} a{w}b {w}" for w in WHITESPACE] + ["​keep​"]
    assert evaluate(spark, values, text.strip) == [v.strip() for v in values]


@pytest.mark.skipif(not has_fixed_suffix_rule(), reason="other suffix rule")
def test_names_follow_posix_paths(spark):
    assert evaluate(spark, NAMES, paths.base_name) == [PurePosixPath(n).name for n in NAMES]
    assert evaluate(spark, NAMES, paths.featurize_name) == [python_featurize(n) for n in NAMES]
    suffixes = [sorted({s.lower() for s in PurePosixPath(n.lower()).suffixes}) for n in NAMES]
    assert [sorted(x) for x in evaluate(spark, NAMES, paths.path_suffixes)] == suffixes


def test_suffix_test_equals_suffix_set(spark):
    listed = ["gz", "jpg", "env", "b"]
    wanted = [bool({s.lstrip(".") for s in PurePosixPath(n.lower()).suffixes} & set(listed)) for n in NAMES]
    assert evaluate(spark, NAMES, lambda c: paths.names_any_suffix(paths.suffix_part(c), listed)) == wanted


def test_model_text_keeps_letter_case_of_token_and_content(spark):
    df = spark.createDataFrame([("My_File.PDF", " Some \n Text ")], "f string, c string")
    row = df.select(paths.model_text_input(F.col("f"), F.col("c")).alias("x")).first()
    assert row.x == "[FILE] my file EXT_pdf [CONTENT] Some Text"


def test_falsy_scalars_are_empty(spark):
    assert evaluate(spark, [0, 7, None], lambda c: text.normalize_value(c, one_column(spark, [1], "bigint").schema["v"].dataType), "bigint") == ["", "7", ""]
    numbers = [0.0, 1.0, 0.25, 12345678.5, None]
    dtype = one_column(spark, [1.0], "double").schema["v"].dataType
    assert evaluate(spark, numbers, lambda c: text.normalize_value(c, dtype), "double") == ["", "1.0", "0.25", "12345678.5", ""]
    flags = one_column(spark, [True], "boolean").schema["v"].dataType
    assert evaluate(spark, [True, False, None], lambda c: text.normalize_value(c, flags), "boolean") == ["True", "", ""]


def test_nested_lists_are_flattened(spark):
    df = spark.createDataFrame([([["a ", ""], None, [" b  c"]],), (None,)], "v array<array<string>>")
    flat = text.normalize_value(F.col("v"), df.schema["v"].dataType)
    assert sorted(r.x for r in df.select(flat.alias("x")).collect()) == ["", "a b c"]


def test_candidates_ignore_case_and_missing_columns(spark):
    df = spark.createDataFrame([(" ", "u", None), (" T ", "u", "b")], "Title string, URL string, body string")
    rows = df.select(
        text.first_present(df, ["nope", "title", "url"]).alias("first"),
        text.collect_present(df, ["body", "TITLE", "nope"]).alias("all"),
        text.first_present(df, ["nope"]).alias("none"),
    ).collect()
    assert [tuple(r) for r in rows] == [("u", "", ""), ("T", "b T", "")]


def test_fallback_names(spark):
    df = spark.createDataFrame([("  ", "Logs", 3), (" x ", "Docs", 4), (None, "Study", 5), ("y" * 200, "Docs", 6)], "n string, l string, i int")
    named = [r.x for r in df.select(paths.ensure_filename(F.col("n"), F.col("l"), F.col("i")).alias("x")).collect()]
    assert named == ["logs_sample_3.log", "x", "study_sample_5.txt", "y" * 180]


def test_hidden_names(spark):
    values = ["a.txt", ".a", "~a", "_a", "d/.x", ".d/x", "", "/"]
    assert evaluate(spark, values, paths.visible_name) == [True, False, False, True, False, True, False, False]


def test_previews_count_code_points(spark):
    values = ["😀" * 600, " " + "x" * 499 + "  tail", "\n\n"]
    assert evaluate(spark, values, text.extracted_text) == [v[:500].strip() for v in values]
    assert evaluate(spark, ["a\nb" * 100], text.error_preview) == [("a\nb" * 100)[:220].replace("\n", " ")]


def test_small_look_ups(spark):
    assert evaluate(spark, ["Code", "nope", None], category_icon) == ["💻", "📂", "📂"]
    assert evaluate(spark, [0.8, 0.55, 0.549], confidence_band, "double") == ["high", "medium", "low"]
    assert evaluate(spark, [0.0123, -0.5, 0.0, None], text.signed_delta, "double") == ["+0.0123", "-0.5000", "+0.0000", "n/a"]
    assert evaluate(spark, [0.125, 0.5, 0.994], text.percent_text, "double") == [f"{x:.0%}" for x in (0.125, 0.5, 0.994)]
