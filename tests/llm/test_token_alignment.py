from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from sortflow.llm import token_alignment
from sortflow.llm.token_alignment import ByteLevel, Pieces, align_tokenizers, link_counts, words_of


def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def token_bytes_a():
    """Bytes of A's ids, by the tokenizer's own decoder where a token is whole characters, else by its vocabulary."""
    import json

    spelt = json.load(open(paths()[0], encoding="utf-8"))["model"]["vocab"]
    plain = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    missing = [b for b in range(256) if b not in plain.values()]
    table = plain | {chr(256 + k): b for k, b in enumerate(missing)}
    return {i: bytes(table[c] for c in t) for t, i in spelt.items() if set(t) <= set(table)}


def brute(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(paths()[0])
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=paths()[1])
    a_bytes = token_bytes_a()
    links, said, sizes = [], [], []
    for _, text in docs:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        pieces = [b_model.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        wanted = (" " + text).encode() if text else b""
        if b"".join(a_bytes[i] for i in a) != wanted or b"".join(b_bytes) != wanted:
            a, b, b_bytes = [], [], []
        ends_a, ends_b, at = {}, {}, 0
        for k, i in enumerate(a):
            at += len(a_bytes[i])
            ends_a[at] = k
        at = 0
        for k, x in enumerate(b_bytes):
            at += len(x)
            ends_b[at] = k
        groups, mine, x, y = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a[end], ends_b[end]
            groups.append(",".join(map(str, a[x : i + 1])) + "|" + ",".join(map(str, b[y : j + 1])))
            mine.append((a[i], b[j]))
            x, y = i + 1, j + 1
        links.append(mine)
        said.append(";".join(groups))
        sizes.append((len(a), len(b)))
    counts = Counter(p for mine in links for p in mine)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    rows = []
    for (i, _), mine, text, (n_a, n_b) in zip(docs, links, said, sizes):
        best = sum(counts[p] == highest[p[1]] for p in mine)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        rows.append((i, n_a, n_b, len(mine), len(mine), best, sum(counts[p] for p in mine), digest, text))
    return rows, {(a, b): (n, int(n == highest[b])) for (a, b), n in counts.items()}


def texts(n: int = 120):
    r = random.Random(4)
    odd = [None, "", " ", "a", "  two  spaces ", "tab\tand\nline\r\n", "<|endoftext|> and <s> </s> <unk>", "▁", "a▁b", "été \U0001f600\U0001f469‍\U0001f52c", "\x00\x01", "中文。", "<0x41>"]
    words = "the of and straße über été déjà naïve Привет мир 12345 3.14 foo_bar don't I'm co-operate ,;: ... __init__ http://x.y/z".split()
    made = [r.choice([" ", "  ", "\n"]).join(r.choice(words) for _ in range(r.choice([1, 5, 40, 200]))) for _ in range(n)]
    return list(enumerate(odd + made)) + [(500, made[0]), (500, made[0]), (None, made[1])]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))


@pytest.mark.parametrize("block_bytes", [1, 3_000, 1 << 20])
def test_equals_a_plain_alignment(documents, block_bytes):
    docs = texts()
    found = align_tokenizers(documents(docs, extra="block long, pair int, id long").repartition(3), *paths(), groups=True, block_bytes=block_bytes)
    assert order(tuple(r) for r in found.collect()) == order(brute(docs)[0])


def test_counts_of_pairs(documents):
    docs = texts(40)
    found = link_counts(documents(docs), *paths(), block_bytes=500).collect()
    assert {(r.a, r.b): (r["count"], r.best) for r in found} == brute(docs)[1]


def test_words_are_encoded_as_the_whole():
    r = random.Random(1)
    words = "one two, three. été 中文 x1 _y 'tis don't 10,000 ... ▁z z▁ \u00a0 \x85 \x1c \u2003 \u3000x a\u0301".split(" ")
    for side, path in zip((ByteLevel, Pieces), paths()):
        encode = side(path)
        for _ in range(300):
            text = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\n", " \n", "\t "]) for _ in range(30))
            parts = words_of(text)
            assert len(parts) > 1 and " ".join(parts) == text
            assert [i for ids in encode(parts) for i in ids] == encode([text])[0]
    assert words_of("x" * 1_000) == ["x" * 1_000]


def test_no_piece_spans_a_word_border():
    """What the cut into words rests on: no piece of B holds a space after another character; A cuts words first."""
    for token in Pieces(paths()[1]).tokens.to_pylist():
        assert b" " not in token.lstrip(b" ")


def test_words_are_forgotten(documents, monkeypatch):
    monkeypatch.setattr(token_alignment, "MAX_CHARS", 60)
    monkeypatch.setattr(token_alignment, "SLICE_CHARS", 100)
    aligner, docs = token_alignment.Aligner(*paths()), texts(60)
    found = [row for _, part in token_alignment._slices(pa.array([t for _, t in docs])) for row in aligner(part)[0].to_pylist()]
    assert [(r["n_a"], r["n_b"], r["groups"]) for r in found] == [(r[1], r[2], r[8]) for r in brute(docs)[0]]


def test_long_text_and_empty_table(documents):
    docs = [(1, "word " * 120_000), (2, "y" * 20_000), (3, None)]
    assert order(tuple(r) for r in align_tokenizers(documents(docs), *paths(), groups=True).collect()) == order(brute(docs)[0])
    assert align_tokenizers(documents([]), *paths()).count() == 0
    only_null = align_tokenizers(documents([(7, None), (8, "")]), *paths()).collect()
    assert [tuple(r)[1:] for r in only_null] == [(0, 0, 0, 0, 0, 0, "")] * 2
