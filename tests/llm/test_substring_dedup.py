from __future__ import annotations

import random

import pyarrow as pa

from sortflow.llm.rows import ROW
from sortflow.llm.substring_dedup import CUT_EVERY, PASSAGE, SENTENCES, WORDS, remove_repeated_spans, window_of
from sortflow.llm.wordbytes import SOLID_BYTES, find_words, span_hashes, text_slices


def sentences_of(text: str):
    """Sentences as lists of (start, end, lower-cased word); cuts follow the rule word by word."""
    texts = next(text_slices(pa.array([text])))
    words = find_words(texts, SOLID_BYTES)
    hashes = span_hashes(texts, words.start, words.end)
    raw, out, current = text.encode(), [], []
    for i, (a, b, h) in enumerate(zip(words.start, words.end, hashes)):
        current.append((int(a), int(b), texts.data[a:b].tobytes()))
        after = raw[b : words.start[i + 1]] if i + 1 < len(words.start) else b"\n"
        if raw[b - 1 : b] in (b".", b"!", b"?") or b"\n" in after or int(h) % CUT_EVERY == 0:
            out.append(current)
            current = []
    if current:
        out.append(current)
    return out


def brute(docs: list[tuple[int, str | None]]) -> dict[int, tuple[str | None, int]]:
    cut = {doc: sentences_of(text or "") for doc, text in docs}
    spans, first = [], {}
    for doc in sorted(cut):
        s = cut[doc]
        for i in range(len(s)):
            j = i + SENTENCES
            while j <= len(s) and sum(len(x) for x in s[i:j]) < WORDS:
                j += 1
            if j <= len(s):
                key = tuple(w for x in s[i:j] for _, _, w in x)
                first.setdefault(key, (doc, i))
                spans.append((key, doc, i, j))
    gone = {doc: set() for doc in cut}
    for key, doc, i, j in spans:
        if first[key] != (doc, i):
            gone[doc].update(range(i, j))
    out = {}
    for doc, text in docs:
        s, raw = cut[doc], (text or "").encode()
        if not gone[doc]:
            out[doc] = (text, 0)
            continue
        starts = [0] + [x[0][0] for x in s[1:]] + [len(raw)]
        out[doc] = (b"".join(raw[starts[i] : starts[i + 1]] for i in range(len(s)) if i not in gone[doc]).decode(), len(gone[doc]))
    return out


def made(r: random.Random):
    words = [f"w{i}" for i in range(400)] + ["Éa", "ß", "x."]
    say = lambda n: " ".join(r.choice(words) + r.choice(["", "", "", ".", "!", "\n"]) for _ in range(n))
    passages = [say(60) for _ in range(6)]
    docs = []
    for i in range(150):
        parts = [say(r.randrange(0, 60)) for _ in range(3)]
        if i % 3 == 0:
            parts.insert(1, r.choice(passages))
        docs.append((i, " ".join(parts)))
    docs += [(200, docs[5][1]), (201, None), (202, ""), (203, "One. Two. Three. " * 30), (204, "a b c d e f g " * 5000)]
    return docs, passages


def test_equals_the_plain_rule(documents):
    docs, _ = made(random.Random(3))
    found = remove_repeated_spans(documents(docs)).collect()
    expected = brute(docs)
    assert {r[ROW]["doc_id"]: (r["text"], r["n_removed"]) for r in found} == expected
    assert sum(n > 0 for _, n in expected.values()) > 40


def test_planted_passages_go_and_clean_texts_stay(documents):
    r = random.Random(4)
    words = [f"v{i}" for i in range(5000)]
    passage = " ".join(r.choice(words) for _ in range(60))
    docs = [(i, " ".join(r.choice(words) for _ in range(200))) for i in range(60)]
    docs = [(i, f"{t[:400]} {passage} {t[400:]}" if i % 2 else t) for i, t in docs]
    found = {r[ROW]["doc_id"]: r for r in remove_repeated_spans(documents(docs)).collect()}
    assert all(found[i]["n_removed"] == 0 for i in range(0, 60, 2)) and found[1]["n_removed"] == 0
    assert all(found[i]["n_words_removed"] >= 24 for i in range(3, 60, 2))


def test_every_passage_of_51_words_holds_a_span(documents):
    """Passages of many and of few different words, pasted into the middle of other sentences."""
    assert window_of(PASSAGE) == 8
    r = random.Random(9)
    words = [f"v{i}" for i in range(5000)]
    say = lambda n, some: [r.choice(some) for _ in range(n)]
    passages = [say(PASSAGE, words if i % 3 else r.sample(words, 1 + i // 3 % 5)) for i in range(300)]
    docs = [(1000 * c + i, " ".join(say(40, words) + p + say(40, words))) for c in (0, 1) for i, p in enumerate(passages)]
    found = {x[ROW]["doc_id"]: x["n_words_removed"] for x in remove_repeated_spans(documents(docs), passage=PASSAGE).collect()}
    assert all(WORDS <= found[1000 + i] <= PASSAGE for i in range(1, 300, 3))
    assert all(WORDS <= found[1000 + i] <= PASSAGE for i in range(2, 300, 3))
    assert all(found[1000 + i] >= WORDS for i in range(0, 300, 3))
    assert all(found[i] == 0 for i in range(300) if i % 3)


def test_odd_tables(documents):
    text = " ".join(f"word{i}." for i in range(40))
    rows = remove_repeated_spans(documents([(None, text), (None, text), (None, text + " more."), (3, text), (3, text)], extra="spans string, doc long"))
    kept = [(r[ROW]["doc_id"], r["text"], r["n_removed"]) for r in rows.collect()]
    assert len(kept) == 5
    assert len({k for k in kept if k[0] == 3}) == 1
    assert remove_repeated_spans(documents([])).count() == 0
