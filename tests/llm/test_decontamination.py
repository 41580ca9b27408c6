from __future__ import annotations

import hashlib
import random
import re

import pytest

from sortflow.llm import decontamination
from sortflow.llm.decontamination import contamination, decontaminate, find_benchmark_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[tuple(w[i : i + k])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out)


def made():
    r = random.Random(1)
    vocabulary = ["The", "ärger", "x9", "of", "naïve", "B", "日本", "and"] + [f"word{i}" for i in range(40)]
    say = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", ",", ".", "\n", "!?"]) for _ in range(n))
    items = [(i, say(r.choice([12, 15, 30]))) for i in range(12)] + [(20, "only four words here"), (21, ""), (22, "..."), (23, "zzz")]
    items += [(24, items[3][1]), (100, items[4][1])]
    docs = []
    for i in range(120):
        parts = [say(r.randrange(0, 40)), say(r.randrange(0, 10))]
        if i % 3 == 0:
            text = r.choice(items)[1]
            parts.insert(1, text if r.random() < 0.7 else " ".join(text.split()[:11]).upper())
        docs.append((i, " ".join(parts)))
    return docs + [(500, None), (501, ""), (502, "- . -"), (503, "word1 " * 40_000 + items[0][1])], items


@pytest.mark.parametrize("blocks", [1, 4])
def test_equals_the_plain_rule(spark, documents, blocks):
    docs, items = made()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = find_benchmark_words(documents(docs), benchmark, max_windows=200_000 if blocks == 1 else 60)
    if blocks == 1:
        rows = contamination(documents(docs), benchmark).drop("items").collect()
        assert sorted(tuple(r) for r in rows) == brute(docs, items)
    expected = {doc: (n, hit) for doc, n, hit, *_ in brute(docs, items)}
    assert {r["row"]["doc_id"]: (r["n_words"], len(r["hit_words"])) for r in found.collect()} == expected


def test_a_window_of_very_many_items_is_spread_over_blocks(spark, documents, monkeypatch):
    sizes = []

    made_of = decontamination.WindowIndex.__init__

    def counted(self, rows):
        sizes.append(len(rows))
        made_of(self, rows)

    monkeypatch.setattr(decontamination.WindowIndex, "__init__", counted)
    same = " ".join(f"w{i}" for i in range(10))
    benchmark = spark.createDataFrame([(i, same) for i in range(500)], "item_id long, text string")
    found = find_benchmark_words(documents([(1, f"x {same} y"), (2, "x y")]), benchmark, max_windows=100)
    rows = {r["row"]["doc_id"]: r for r in found.collect()}
    assert len(sizes) == 5 and sum(sizes) == 500 and max(sizes) < 150
    assert rows[1]["items"] == sorted(str(i) for i in range(500)) and rows[1]["hit_words"] == list(range(1, 11))
    assert rows[2]["items"] == [] and rows[2]["n_words"] == 2


def test_removal(spark, documents):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = documents([(1, f"Before, {item.upper()}! After."), (2, "clean text"), (3, None)], extra="items string, hit_words long")
    kept = decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    spans = {r["doc_id"]: r["text"] for r in decontaminate(docs, benchmark, remove="spans").collect()}
    assert spans == {1: "Before, ! After.", 2: "clean text", 3: None}
    with pytest.raises(ValueError):
        decontaminate(docs, benchmark, remove="lines")


def test_odd_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    odd = spark.createDataFrame([(None, "a b"), (None, None)], "item_id long, text string")
    docs = documents([(None, "x a b"), (1, "x a b"), (1, "x a b")])
    assert [r["n_hit"] for r in contamination(docs, none).collect()] == [0, 0, 0]
    assert [(r["n_hit"], r["n_items"]) for r in contamination(docs, odd).collect()] == [(2, 0)] * 3
    assert contamination(documents([]), odd).count() == 0
    assert decontamination.WINDOW == 10
