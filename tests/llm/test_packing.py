from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sortflow.llm import packing
from sortflow.llm.packing import Packer, Tokeniser, pack_documents
from sortflow.llm.queries import tokenizer_path
from sortflow.llm.wordbytes import find_words, span_hashes, text_slices, word_hashes


def ids_of(texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    return [e.ids + [2] for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def made(n=300):
    r = random.Random(8)
    words = ["The", "naïve", "don't", "x9,", "É́t,", "(a.b)", "…", "日本語。", "ÄÖ.", "×.", "end!", "w1;", "<|endoftext|>", "<|EndOfText|>", "x.<|startoftext|>'t", "<|<|endoftext|>́e", "<|endoftext", "😀.", " ", "a　b"]
    words += ["".join(r.choice("abcdefgéß") for _ in range(r.randrange(1, 9))) for _ in range(300)]
    docs = [(i, r.choice([" ", "\n", "\t "]).join(r.choice(words) for _ in range(int(2 ** r.uniform(0, 11))))) for i in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "long " * 30_000)]


@pytest.mark.parametrize("block_tokens", [packing.BLOCK_TOKENS, 9_000])
def test_every_id_is_packed_once(documents, block_tokens):
    docs = made()
    rows = pack_documents(documents(docs).repartition(3), tokenizer_path(), block_tokens=block_tokens).collect()
    ids = dict(zip((d for d, _ in docs), ids_of(t for _, t in docs)))
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert r["length"] == len(own) > 0 and r["ids_crc32"] == zlib.crc32(own.tobytes())
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"], r["tier"], r["step_group"]))
    for doc, own in ids.items():
        at = 0
        for start, length in sorted(pieces[doc]):
            assert start == at
            at += length
        assert at == len(own)
    unfilled = 0
    for parts in windows.values():
        at = 0
        for offset, length, *_ in sorted(parts):
            assert offset == at
            at += length
        tier = parts[0][2]
        assert len({p[2:] for p in parts}) == 1 and at <= tier
        unfilled += at < tier
    assert unfilled <= 1


def test_step_groups_have_equal_mixtures(documents):
    rows = pack_documents(documents(made(600)).repartition(2), tokenizer_path(), step_tokens=1 << 15).collect()
    per_group = defaultdict(Counter)
    for sequence, tier, group in {(r["sequence_id"], r["tier"], r["step_group"]) for r in rows}:
        per_group[group][tier] += 1
    for tier in packing.TIERS:
        counts = [c[tier] for c in per_group.values()]
        assert max(counts) - min(counts) <= 1


def test_strings_of_added_tokens_get_their_id(documents):
    texts = ["hello <|endoftext|> world", "a<|endoftext|>B", "<|ENDOFTEXT|>", "<|endof", "text|>", "<|startoftext|><|endoftext|>", "<|<|startoftext|>|>"]
    rows = pack_documents(documents(list(enumerate(texts))).coalesce(1), tokenizer_path()).collect()
    got = {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in rows}
    wanted = ids_of(texts)
    assert wanted[0].count(49407) == 1 and len(wanted[0]) == 4 and 49407 not in wanted[2] + wanted[3]
    assert got == {i: (len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for i, w in enumerate(wanted)}


def test_memory_of_tokenising_does_not_grow_with_a_text():
    """Words are hashed, and new ones learnt, some at a time; ids are those of the whole text."""
    import tracemalloc

    import pyarrow as pa

    r = random.Random(3)
    text = " ".join("".join(r.choice("abcdefg") for _ in range(r.randrange(1, 9))) for _ in range(400_000))
    whole = next(text_slices(pa.array([text]), lower=False))
    tokenise = Tokeniser(tokenizer_path())
    tokenise.model = Recorder(tokenise.model)
    tracemalloc.start()
    ids, _ = tokenise(whole)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids.tolist() == ids_of([text])[0]
    assert max(tokenise.model.words) <= packing.LEARN_WORDS < sum(tokenise.model.words)
    words = find_words(whole, packing._SOLID)
    assert np.array_equal(word_hashes(whole, words, 50), span_hashes(whole, words.start, words.end))
    assert peak < 60 * len(text)


class Recorder:
    """A tokenizer that notes how many words it gets."""

    def __init__(self, model):
        self.model, self.words = model, []

    def encode(self, text, **options):
        self.words.append(text.count("\n") + 1)
        return self.model.encode(text, **options)


def test_gaps_are_filled_with_what_fits():
    packer = Packer((8, 16))
    for n in (10, 6, 4, 3):
        packer.add((n, n), 0, np.arange(n, dtype=np.uint32))
    tier, parts = next(packer.full(last=True))
    assert tier == 16 and [len(p[2]) for p in parts] == [10, 6]


def test_odd_tables(documents):
    assert pack_documents(documents([]), tokenizer_path()).count() == 0
    rows = pack_documents(documents([(None, None), (None, "same"), (1, "same"), (1, "same")], extra="tier int, ids binary"), tokenizer_path()).collect()
    assert len({r["sequence_id"] for r in rows}) == 1 and sum(r["length"] for r in rows) == sum(len(x) for x in ids_of([None, "same", "same", "same"]))
