from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sortflow.functions.ngrams import char_grams
from sortflow.operators import features as ops

TEXTS = [
    "The Quick brown fox, the quick dog", "Ünïcode wörter über_alles 42 x", "a b c", "", "   ",
    "Привет мир, привет Мир", "tab\tnew\nline  the fox", "hyphen-ated the_end fox fox fox",
]


def words(text):
    return re.findall(r"(?u)\b\w\w+\b", text.lower())


def word_terms(text):
    w = words(text)
    return w + [" ".join(p) for p in zip(w, w[1:])]


def char_terms(text, low, high):
    out = []
    for word in text.lower().split():
        word = f" {word} "
        for n in range(low, high + 1):
            out += [word[i : i + n] for i in range(max(len(word) - n + 1, 1))]
            if len(word) <= n:
                break
    return out


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string")


def counted(df):
    return {(r.id, r.term): r.tf for r in ops.term_counts(df, "id").collect()}


def expected(terms):
    return {(i, t): n for i, text in enumerate(TEXTS) for t, n in Counter(terms(text)).items()}


def test_word_counts(docs):
    assert counted(ops.word_occurrences(docs, "id", "text", 1)) == expected(words)
    assert counted(ops.word_occurrences(docs, "id", "text", 2)) == expected(word_terms)
    with pytest.raises(ValueError):
        ops.word_occurrences(docs, "id", "text", 3)


@pytest.mark.parametrize(("low", "high"), [(2, 4), (3, 5)])
def test_char_counts_and_arrays(docs, low, high):
    assert counted(ops.char_occurrences(docs, "id", "text", low, high)) == expected(lambda t: char_terms(t, low, high))
    arrays = docs.select("id", F.expr(char_grams("text", low, high)).alias("g")).collect()
    assert {r.id: Counter(r.g) for r in arrays} == {i: Counter(char_terms(t, low, high)) for i, t in enumerate(TEXTS)}


def plain_tfidf(terms, cap):
    total, df = Counter(), Counter()
    for text in TEXTS:
        total.update(terms(text))
        df.update(set(terms(text)))
    kept = sorted(total, key=lambda t: (-total[t], t))[:cap]
    idf = {t: math.log((1 + len(TEXTS)) / (1 + df[t])) + 1 for t in kept}
    out = {}
    for i, text in enumerate(TEXTS):
        weights = {t: n * idf[t] for t, n in Counter(terms(text)).items() if t in idf}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        out |= {(i, t): w / norm for t, w in weights.items()}
    return out


def test_tfidf_equals_plain_python(docs):
    found = ops.word_occurrences(docs, "id", "text", 2)
    got = ops.l2_normalised(ops.tfidf(docs, found, "id", 12), "id").collect()
    wanted = plain_tfidf(word_terms, 12)
    assert {(r.id, r.term) for r in got} == set(wanted)
    assert all(r.weight == pytest.approx(wanted[r.id, r.term], abs=1e-12) for r in got)


def test_pipeline_agrees_with_tables(spark, docs):
    corpus = docs.select("id", F.lit("name.txt").alias("filename"), F.col("text").alias("content"))
    blocks = (
        ops.Block("w", "content", "word", 1, 2, 12),
        ops.Block("c", "content", "char", 3, 5, 20),
    )
    model = ops.fit_features(corpus, "id", blocks)
    rows = model.transform(corpus).select("id", vector_to_array("features").alias("v")).collect()
    vectors = {r.id: r.v for r in rows}
    for i in range(len(TEXTS)):
        values = sorted(w for (d, _), w in plain_tfidf(word_terms, 12).items() if d == i)
        values += sorted(w for (d, _), w in plain_tfidf(lambda t: char_terms(t, 3, 5), 20).items() if d == i)
        assert sorted(x for x in vectors[i] if x) == pytest.approx(sorted(values), abs=1e-12)
        for part in (vectors[i][:12], vectors[i][12:]):
            assert math.sqrt(sum(x * x for x in part)) == pytest.approx(1.0) or not any(part)


@pytest.mark.parametrize("largest", [8 << 20, 20])
@pytest.mark.parametrize("rows", [1, 100_000])
def test_document_terms_equal_plain_counts(spark, monkeypatch, largest, rows):
    """Equal and null ids are one document each, also across batches and for ids that Spark counts."""
    monkeypatch.setattr(ops, "DOCUMENT_BYTES", largest)
    monkeypatch.setattr(ops, "_BATCH", rows)
    data = [(None if i % 5 == 0 else i // 2, text) for i, text in enumerate([*TEXTS, None, "nul\x00 \x00", *TEXTS])]
    docs = spark.createDataFrame(data, "id bigint, text string")
    for block, terms in (
        (ops.Block("w", "text", "word", 1, 2, 9), word_terms),
        (ops.Block("w", "text", "word", 1, 1, 9), words),
        (ops.Block("c", "text", "char", 3, 5, 9), lambda t: char_terms(t, 3, 5)),
        (ops.Block("c", "text", "char", 2, 4, 9), lambda t: char_terms(t, 2, 4)),
        (ops.Block("c", "text", "char", 4, 5, 9), lambda t: char_terms(t, 4, 5)),
        (ops.Block("c", "text", "char", 3, 15, 9), lambda t: char_terms(t, 3, 15)),
    ):
        wanted = Counter()
        for i, text in data:
            wanted.update((i, term) for term in terms(text or ""))
        got = [((r.id, r.term), r.tf) for r in ops.document_terms(docs, "id", block).collect()]
        assert len(got) == len(wanted) and dict(got) == wanted
        totals = Counter()
        for (_, term), n in wanted.items():
            totals[term] += n
        df = Counter(term for _, term in wanted)
        found = ops.term_totals(docs, "id", block).collect()
        assert sorted((r.term, r.total, r.df) for r in found) == sorted((t, n, df[t]) for t, n in totals.items())


def test_documents_lie_in_partitions_of_bounded_bytes(spark, monkeypatch):
    monkeypatch.setattr(ops, "PARTITION_BYTES", 100)
    docs = spark.range(40).select("id", F.repeat(F.lit("word "), 10).alias("text"))
    for found in (ops.occurrences(docs, "id", ops.Block("w", "text", "word", 1, 2, 9)),
                  ops.document_terms(docs, "id", ops.Block("w", "text", "word", 1, 2, 9))):
        assert found.rdd.getNumPartitions() == 2_000 // 100 + 1
