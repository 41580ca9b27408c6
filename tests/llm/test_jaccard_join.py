from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from sortflow.llm import jaccard_join
from sortflow.llm.jaccard_join import CountTree, keep_one_of_each, link_components, needed_overlap


def shingles(text: str | None, width: int) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute(docs, width: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t, width) for i, t in docs}
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(r: random.Random, n: int = 220):
    """Chains and stars of edits around a few texts, from very small edits to ones beyond the threshold."""
    words = [f"W{i}" for i in range(300)]
    docs: list[tuple[int, str]] = []
    for i in range(n):
        if i < 12 or r.random() < 0.15:
            docs.append((i, " ".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 5, 8, 30, 60, 120])))))
        else:
            old = r.choice(docs)[1].split()
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                at = r.randrange(len(old) + 1)
                old[at : at + r.choice([0, 1])] = [r.choice(words)] * r.choice([0, 1])
            docs.append((i, r.choice([" ", "  ", "\n"]).join(old)))
    return docs + [(1000, None), (1001, ""), (1002, " \n "), (1003, "x" * 50_000), (1004, "a b " * 20_000), (1005, "A B " * 20_000)]


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_equals_all_pairs(documents, width, percent):
    docs = near_copies(random.Random(width))
    found = link_components(documents(docs), width, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(docs, width, percent)


def test_blocks_of_a_large_cell(documents, monkeypatch):
    """One base text, every copy with its own edits: cells hold many components and are cut into blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    r = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    docs = []
    for i in range(120):
        text = list(base)
        for k in range(r.choice([2, 3, 4])):
            text[r.randrange(100)] = f"own{i}x{k}" if r.random() < 0.7 else f"shared{k}"
        docs.append((i, " ".join(text)))
    found = link_components(documents(docs), 3, 90).collect()
    expected = brute(docs, 3, 90)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == expected
    assert 1 < len({c for _, c in expected.values()}) < 120


def test_tree_loses_no_pair():
    r = np.random.default_rng(2)
    base = r.poisson(3, (40, 64))
    points = np.maximum(0, base[r.integers(40, size=700)] + r.integers(-1, 2, (700, 64)) * (r.random((700, 64)) < 0.1))
    sizes, components = points.sum(axis=1), r.integers(0, 300, 700)
    tree = CountTree(points, sizes, components)
    query, point = tree.search(points, sizes, components, 90)
    shared = np.minimum(points[:, None], points[None]).sum(axis=2)
    wanted = (shared >= needed_overlap(sizes[:, None], sizes[None], 90)) & (components[:, None] != components[None])
    wanted &= (90 * sizes[:, None] <= 100 * sizes[None]) & (90 * sizes[None] <= 100 * sizes[:, None])
    assert set(zip(query.tolist(), point.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(wanted))))


def test_one_of_each_stays(documents):
    """By row, not by id: repeated rows, rows without an id, and one id with two texts."""
    text, other = " ".join(f"t{i}" for i in range(80)), " ".join(f"u{i}" for i in range(60))
    docs = [(4, text), (2, text + " end"), (2, text + " end"), (3, "quite another text of some words here"), (7, ""), (8, None), (8, None), (None, text)]
    docs += [(5, other), (4, other + " x"), (None, "without an id at all here"), (None, "without an id at all here"), (9, "alone"), (9, "on its own")]
    kept = keep_one_of_each(documents(docs, extra="component string, node long, place long, id long, last int, digest int")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    expected = [docs[1], docs[3], docs[4], docs[5], docs[6], docs[9], docs[10], docs[12], docs[13]]
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=key) == sorted(expected, key=key)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_nobody_meets_in_emptiness(width, percent):
    """Two texts of one cell share a shingle; all linked texts share a cell."""
    r = random.Random(percent)
    texts = [t for _, t in near_copies(r, 150)] + [" ".join(f"x{r.random()}" for _ in range(r.choice([9, 20, 50, 90, 400]))) for _ in range(300)]
    for part in jaccard_join.text_slices(pa.array(texts), 1 << 30):
        row, runs = jaccard_join.shingle_sets(part, width)
        owner, key = jaccard_join.cell_keys(row, runs, part.rows, percent)
        sets = [set(runs[row == i].tolist()) for i in range(part.rows)]
    cells: dict[int, set] = {}
    for i, k in zip(owner.tolist(), key.tolist()):
        cells.setdefault(k, set()).add(i)
    met = {(a, b) for members in cells.values() for a in members for b in members if a < b}
    assert all(sets[a] & sets[b] for a, b in met)
    linked = {
        (a, b)
        for a in range(len(sets))
        for b in range(a + 1, len(sets))
        if sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= percent * max(1, len(sets[a] | sets[b]))
    }
    assert len(linked) > 10 and linked <= met


def test_a_group_of_near_copies_sends_no_pairs(documents, monkeypatch):
    """The trees return at most one row for each node but one, however many pairs are linked."""
    sent, united = [], jaccard_join._Join._united
    monkeypatch.setattr(jaccard_join._Join, "_united", lambda self, *args: sent.append(united(self, *args)) or sent[-1])
    r = random.Random(5)
    base, docs = [f"b{i}" for i in range(200)], []
    for i in range(150):
        text = list(base)
        for _ in range(r.choice([2, 3, 3, 4])):
            text[r.randrange(200)] = f"own{i}"
        docs.append((i, " ".join(text)))
    expected = brute(docs, 3, 90)
    found = link_components(documents(docs), 3, 90).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == expected
    assert sum(df.count() for df in sent) <= len(docs) - 1


def test_odd_tables(documents):
    assert link_components(documents([])).count() == 0
    rows = link_components(documents([(5, "same words"), (5, "same words"), (None, "Same  words"), (9, None)], extra="id long, n long, node long"))
    found = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in rows.collect())
    assert found == [(-1, 1, 5), (5, 1, 5), (5, 1, 5), (9, 0, 9)]


def test_partners_are_found_in_little_memory():
    """Counts of unrelated texts: the bounds of nodes let nearly all pairs through, those of texts few."""
    r, n = np.random.default_rng(4), 2_048
    counts = r.poisson(5, (n, jaccard_join.GROUPS)).astype("<u4")
    counts[n // 2 :: 9] = counts[: n - n // 2 : 9]
    fine = np.zeros((n, jaccard_join.FINE_GROUPS), "<u2")
    fine[:, : jaccard_join.GROUPS] = counts
    table = pa.table(
        {
            "shard": np.zeros(n, np.int64),
            "side": pa.array(np.zeros(n), pa.int32()),
            "node": np.arange(n),
            "component": np.arange(n),
            "n": counts.sum(axis=1).astype(np.int64),
            "counts": pa.array([c.tobytes() for c in counts], pa.binary()),
            "data": pa.array([c.tobytes() for c in fine], pa.binary()),
        }
    )
    tracemalloc.start()
    found = jaccard_join._with_partners(80)(table)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6
    size, wanted = counts.sum(axis=1, dtype=np.int64), np.zeros(n, bool)
    for i in range(n):
        other = np.minimum(counts[i], counts).sum(axis=1, dtype=np.int64) >= needed_overlap(size[i], size, 80)
        other[i] = False
        wanted[i] = other.any()
    assert found.column("node").to_pylist() == np.flatnonzero(wanted).tolist()


@pytest.mark.parametrize("rows", [0, 1, 7])
def test_rows_of_a_binary_column(rows):
    values = np.arange(rows * 3, dtype="<u4").reshape(rows, 3)
    column = pa.array([b"skipped 12 b", *(v.tobytes() for v in values)], pa.binary())
    for given in (column.slice(1), pa.chunked_array([column.slice(1)]), pa.chunked_array([column.slice(1, 1), column.slice(2)] if rows else [], pa.binary())):
        assert np.array_equal(jaccard_join._rows_of(given, "<u4", 3), values)
