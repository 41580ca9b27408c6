from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from sortflow.llm import simhash_join
from sortflow.llm.simhash_join import BKForest, link_marks, simhash_components


def fingerprint(text: str | None, width: int = 3) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(marks: list[int], radius: int) -> list[int]:
    """Smallest index reachable by links, for every mark, by all pairs."""
    label = list(range(len(marks)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= radius:
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(marks))]


def near_texts(r: random.Random, n: int = 260):
    words = [f"W{i}é" for i in range(400)]
    docs: list[tuple[int, str]] = []
    for i in range(n):
        if i < 15 or r.random() < 0.2:
            docs.append((i, " ".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 4, 40, 150, 300])))))
        else:
            old = r.choice(docs)[1].split()
            for _ in range(r.choice([0, 1, 1, 2])):
                at = r.randrange(len(old) + 1)
                old[at : at + 1] = [r.choice(words)]
            docs.append((i, r.choice([" ", "  ", "\n"]).join(old)))
    return docs + [(900, None), (901, ""), (902, " \n "), (903, "z" * 40_000), (904, "a b " * 20_000), (905, "A B " * 20_000)]


@pytest.mark.parametrize(("width", "radius"), [(3, 2), (1, 0), (3, 6)])
def test_equals_all_pairs(documents, width, radius):
    docs = near_texts(random.Random(width + radius))
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_components(documents(docs), width, radius).collect()}
    marks = [fingerprint(t, width) for _, t in docs]
    expected = {i: (f"{m:016x}", docs[c][0]) for (i, _), m, c in zip(docs, marks, components(marks, radius))}
    assert found == expected
    assert len(set(marks)) - len({c for _, c in expected.values()}) >= 10 * (radius > 0)


def clusters(r: random.Random, centres: int, each: int, flips: int) -> list[int]:
    marks = set()
    for _ in range(centres):
        centre = r.getrandbits(64)
        for _ in range(each):
            mark = centre
            for _ in range(r.randrange(flips + 1)):
                mark ^= 1 << r.randrange(64)
            marks.add(mark)
    return sorted(marks)


def test_every_tree_finds_all_within_the_radius():
    r = random.Random(7)
    marks = np.array(clusters(r, 30, 20, 6), np.uint64)
    tree = np.arange(len(marks)) % 3
    forest = BKForest(marks, tree)
    found = set()
    for query, node in forest.search(marks, tree, 3):
        pairs = list(zip(query.tolist(), node.tolist()))
        assert not found & set(pairs)
        found |= set(pairs)
    apart = np.bitwise_count(marks[:, None] ^ marks[None])
    assert found == set(zip(*(x.tolist() for x in np.nonzero((apart <= 3) & (tree[:, None] == tree[None])))))
    below = [i for i in range(len(marks)) if forest.edges[np.flatnonzero(forest.order == i)[0]] >= 0]
    assert len(below) == len(marks) - 3


@pytest.mark.parametrize(("block", "bucket"), [(8_192, 1 << 16), (6, 10)])
def test_large_shards_are_cut_into_blocks(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(simhash_join, "BLOCK", block)
    monkeypatch.setattr(simhash_join, "BUCKET", bucket)
    marks = clusters(random.Random(3), 12, 60, 3)
    signed = np.array(marks, np.uint64).view(np.int64).tolist()
    found = {r.node: r.component for r in link_marks(spark.createDataFrame([(m,) for m in signed], "mark long")).collect()}
    label = components(marks, 2)
    groups: dict[int, set] = {}
    for mark, c in zip(signed, label):
        groups.setdefault(c, set()).add(mark)
    expected = {m: min(g) for g in groups.values() if len(g) > 1 for m in g}
    assert found == expected


def test_a_group_of_near_marks_sends_no_pairs(spark, monkeypatch):
    """n marks, each within the radius of the others: at most n - 1 rows leave the search."""
    sent = []
    search = simhash_join._search
    monkeypatch.setattr(simhash_join, "_search", lambda rows, radius: sent.append(search(rows, radius)) or sent[-1])
    base = 0x0123456789ABCDEF
    marks = [base] + [base ^ (1 << i) for i in range(60)]
    found = link_marks(spark.createDataFrame([(m,) for m in marks], "mark long")).collect()
    assert len(found) == len(marks) and len({r.component for r in found}) == 1
    assert sum(df.count() for df in sent) <= len(marks) - 1


def test_odd_tables(documents):
    assert simhash_components(documents([])).count() == 0
    rows = [(5, "same words here now"), (5, "same words here now"), (None, "Same  words here NOW"), (9, None), (8, ""), (None, "quite other words stand here")]
    found = simhash_components(documents(rows, extra="mark long, id long, component long")).collect()
    zero, same, other = "0" * 16, f"{fingerprint(rows[0][1]):016x}", f"{fingerprint(rows[5][1]):016x}"
    expected = [(-1, same, 5), (-1, other, None), (5, same, 5), (5, same, 5), (8, zero, 8), (9, zero, 8)]
    key = lambda r: (r[0], r[1], r[2] or 0)
    assert sorted(((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in found), key=key) == sorted(expected, key=key)
