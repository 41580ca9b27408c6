from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from sortflow.llm import pii
from sortflow.llm.pii import find_disclosures, sanitise, spans_text
from sortflow.llm.rows import ROW

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind: str, piece: str) -> bool:
    digits = re.sub("[^0-9]", "", piece)
    if kind == "ip":
        return all(int(p) <= 255 for p in piece.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text: str | None) -> str:
    found = []
    for number, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            if valid(kind, m[0]):
                found.append((m.start(), number, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def random_text(r: random.Random) -> str:
    bits = ["a@b.c", "x.y@z-1.example.com", "@", ".", "+", "-", " ", "\u0001", "é😀", "4111 1111 1111 1111", "4111111111111111",
            "192.168.0.1", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.004", "+1 (555) 123-4567", "+12", "(", "_d@e.f", "word", "12", "007", "a@b.c_d@e.f"]
    return "".join(r.choice(bits) for _ in range(r.randrange(0, 14)))


def test_entities_equal_the_plain_patterns(spark, documents):
    r = random.Random(5)
    texts = [random_text(r) for _ in range(400)] + [None, "", "9" * 30_000, "a" * 30_000 + "@", "1-" * 20_000, "a@b" + ".c" * 20_000]
    found = find_disclosures(documents(list(enumerate(texts))))
    rows = found.select(F.col(ROW)["doc_id"], spans_text(F.col("entities")), F.sha2(spans_text(F.col("entities")), 256)).collect()
    assert len(rows) == len(texts)
    for doc_id, said, digest in rows:
        assert said == brute(texts[doc_id])
        assert digest == hashlib.sha256(said.encode()).hexdigest()


def corpus():
    rows = [(i, f"The meeting is on floor {i}. Please dial hotline +1 555 010 {2000 + i} before noon.") for i in range(40)]
    rows += [(100 + i, "The meeting about weather and the garden is before noon, please come along to the floor.") for i in range(400)]
    return rows


def test_terms_that_give_entities_away(documents):
    rows = corpus()
    found = find_disclosures(documents(rows)).select(F.col(ROW)["doc_id"].alias("doc_id"), spans_text(F.col("spans")).alias("spans"))
    spans = {r["doc_id"]: r["spans"] for r in found.collect()}
    text = dict(rows)[7]
    at = text.index("hotline")
    assert f"term:{at}:{at + 7}" in spans[7].split(",")
    assert f"phone:{text.index('+')}:{text.index(' before')}" in spans[7].split(",")
    assert "term:" + str(text.index("meeting")) not in spans[7]
    assert all(spans[100 + i] == "" for i in range(400))


def test_sanitised_text(documents):
    rows = [*corpus(), (1000, None), (1001, ""), (1002, "mail a@b.c and 10.0.0.1")]
    clean = {r["doc_id"]: r for r in sanitise(documents(rows), length_col="n_chars").collect()}
    assert "hotline" not in clean[7]["text"] and "[PHONE]" in clean[7]["text"] and "555" not in clean[7]["text"]
    assert clean[7]["n_chars"] == len(clean[7]["text"])
    assert clean[150]["text"] == dict(rows)[150]
    assert clean[1000]["text"] is None and clean[1001]["text"] == ""
    assert clean[1002]["text"] == "mail [EMAIL] and [IP]"


def test_copies_teach_nothing(documents):
    rows = [(i, "Zanzibar Quxville reach me at me@here.org thanks") for i in range(50)]
    found = find_disclosures(documents(rows)).select(spans_text(F.col("spans"))).distinct().collect()
    assert [r[0] for r in found] == ["email:30:41"]


def test_terms_of_a_single_owner(documents):
    """A name that stands in many texts beside its owner's one address, and nowhere else."""
    r = random.Random(8)
    other = [f"{a}{b}{c}" for a in "bdkl" for b in ("ara", "eno", "ili") for c in ("tan", "mos", "rin", "dul")]
    say = lambda n: " ".join(r.choice(other) for _ in range(n))
    rows = [(i, f"{say(30)} Quxville at q@here.org {say(30)}") for i in range(30)]
    rows += [(100 + i, f"{say(60)} at {say(10)}") for i in range(200)]
    rows += [(400 + i, f"{say(30)} Onlyfour f@here.org {say(30)}") for i in range(4)]
    found = find_disclosures(documents(rows)).select(F.col(ROW)["doc_id"].alias("doc_id"), spans_text(F.col("spans")).alias("spans"))
    spans = {x["doc_id"]: x["spans"].split(",") for x in found.collect()}
    for doc_id, text in rows:
        name = re.search("Quxville", text)
        terms = [x for x in spans[doc_id] if x.startswith("term")]
        assert terms == ([f"term:{name.start()}:{name.end()}"] if name else [])
    clean = {x["doc_id"]: x["text"] for x in sanitise(documents(rows)).collect()}
    assert "Quxville" not in "".join(clean.values()) and "Onlyfour" in clean[400]


def test_odd_tables(spark, documents):
    assert find_disclosures(documents([])).count() == 0
    odd = documents([(None, "a@b.c"), (None, "a@b.c"), (1, "a@b.c")], extra="entities string, spans string, row string, place long")
    rows = sanitise(odd)
    assert rows.columns == odd.columns
    assert [r["text"] for r in rows.collect()] == ["[EMAIL]"] * 3


def test_no_python_on_the_main_path(documents):
    plan = sanitise(documents(corpus()))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
    assert pii.SUPPORT > 1


def test_very_many_matches_in_one_text(spark):
    """Spans of a text with thousands of matches, over the border of many runs, and in time that grows with the text."""
    parts = [f"u{i}@m{i}.example.org" if i % 3 else f"text {i}" for i in range(9_000)]
    text, expected, at = " ".join(parts), [], 0
    for part in parts:
        if "@" in part:
            expected.append((at, 0, at + len(part)))
        at += len(part) + 1
    rows = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    spans = rows.select(F.transform(pii.entity_spans(F.coalesce("t", F.lit(""))), lambda s: F.struct(s["start"], s["kind"], s["end"])).alias("s"))
    assert sorted((len(r.s), [tuple(x) for x in r.s]) for r in spans.collect()) == [(0, []), (0, []), (6_000, expected)]
