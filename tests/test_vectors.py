from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sortflow.operators import features, vectors
from test_features import TEXTS, char_terms, word_terms, words

DATA = [*TEXTS, None, "nul\x00 \x00", "a " * 40, "漢字 " + "".join(map(chr, range(0x4E00, 0x4E40))), *TEXTS]
KINDS = [
    ("word", 1, 2, word_terms), ("word", 1, 1, words), ("char", 3, 5, lambda t: char_terms(t, 3, 5)),
    ("char", 4, 6, lambda t: char_terms(t, 4, 6)), ("char", 1, 2, lambda t: char_terms(t, 1, 2)),
]


@pytest.mark.parametrize(("rows", "chars", "table"), [(500, 1 << 20, 1 << 22), (3, 7, 0), (1, 1, 1 << 22)])
def test_vectors_equal_plain_counts(spark, monkeypatch, rows, chars, table):
    """Over borders of pieces and runs, with a table and searched; a null text, which no stage took before, counts as empty."""
    monkeypatch.setattr(vectors, "_TABLE", table)
    blocks, wanted = [], [[] for _ in DATA]
    for i, (analyzer, low, high, terms) in enumerate(KINDS):
        total = Counter(t for text in DATA for t in terms(text or ""))
        kept = sorted(total, key=lambda t: (-total[t], t))[:60]
        idf = [1 + i / 7 + k / 100 for k in range(len(kept))]
        blocks.append({"column": "text", "analyzer": analyzer, "terms": kept, "idf": idf})
        for row, text in enumerate(DATA):
            own = Counter(terms(text or ""))
            weights = [own[t] * w for t, w in zip(kept, idf)]
            norm = math.sqrt(sum(w * w for w in weights)) or 1.0
            wanted[row] += [w / norm for w in weights]
    counter = vectors._Counter(blocks)
    assert all((c.table is None) == (table == 0) for c, _ in counter.blocks if isinstance(c, vectors._GramTerms))
    docs = spark.createDataFrame(list(enumerate(DATA)), "id int, text string").coalesce(1)
    cut = [F.expr((vectors.word_tokens if b["analyzer"] == "word" else vectors.blank_separated)("text")) for b in blocks]
    columns = docs.orderBy("id").select(*[c.alias(f"c{i}") for i, c in enumerate(cut)]).toArrow().combine_chunks().columns
    monkeypatch.setattr(vectors, "_CHARS", chars)
    found = [
        row
        for at in range(0, len(DATA), rows)
        for row in counter.vectors([c.chunk(0).slice(at, rows) for c in columns]).to_pylist()
    ]
    for row, expected in zip(found, wanted):
        dense = dict(zip(row["indices"], row["values"]))
        assert row["indices"] == sorted(dense) and row["size"] == len(expected)
        assert [dense.get(i, 0.0) for i in range(len(expected))] == pytest.approx(expected, abs=1e-12)
    by_spark = vectors.TextVectors(blocks).transform(docs).select("id", vector_to_array("features").alias("v")).collect()
    assert {r.id: r.v for r in by_spark} == {i: pytest.approx(w, abs=1e-12) for i, w in enumerate(wanted)}


def test_texts_are_cut_once_and_no_gram_leaves_a_task(spark):
    corpus = spark.createDataFrame([(i, "a.txt", text or "") for i, text in enumerate(DATA)], "id int, filename string, content string")
    model = features.fit_features(corpus, "id", (features.Block("w", "content", "word", 1, 2, 9), features.Block("c", "content", "char", 3, 5, 9)))
    used = model.transform(corpus).select("id", vector_to_array("features").alias("v")).selectExpr("id", "v[0] + v[9]", "array_max(v)")
    plan = used._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("regexp_replace") == 1 and "lambda" not in plan


def test_without_terms_and_without_rows(spark):
    empty = spark.createDataFrame([(1, "")], "id int, content string")
    block = (features.Block("w", "content", "word", 1, 2, 9),)
    model = features.fit_features(empty, "id", block)
    assert [r.features.size for r in model.transform(empty).collect()] == [0]
    assert model.transform(empty.where("id > 1")).count() == 0
