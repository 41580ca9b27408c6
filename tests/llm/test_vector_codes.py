from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest

from sortflow.llm import vector_codes as codes
from sortflow.llm.vector_codes import hilbert_keys, nearest, shortlist, squared_distances, vector_codes, with_label_errors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts: int, entries: int, rounds: int):
    """Plain rounds over lists of integers."""
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v], label) for i, v, label in rows if usable(v)]
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v + [0] * (width * parts - len(v)), label) for i, v, label in kept]
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[cut(v)[p] for _, v, _ in order[:entries]] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    pick = lambda p, part: min(range(len(books[p])), key=lambda e: (apart(part, books[p][e]), e))
    for _ in range(rounds):
        chosen = [[pick(p, cut(v)[p]) for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v)[p] for (_, v, _), c in zip(kept, chosen) if c[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, label in kept:
        chosen = [pick(p, cut(v)[p]) for p in range(parts)]
        error = sum(apart(cut(v)[p], books[p][c]) for p, c in enumerate(chosen))
        out.append((i, label, "".join(f"{c:02x}" for c in chosen), error))
    total = {}
    for _, label, _, error in out:
        total[label] = total.get(label, 0) + error
    return [(i, label, code, error, total[label], digest) for i, label, code, error in out]


def usable(v) -> bool:
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def vectors(r: random.Random, n: int, dims: int):
    centres = [[r.uniform(-1, 1) for _ in range(dims)] for _ in range(7)]
    rows = []
    for i in range(n):
        centre = r.choice(centres)
        rows.append((i * 3 + 1, [float(np.float32(x + r.gauss(0, 0.05))) for x in centre], r.choice([0, 1, 2, None])))
    same = [float(np.float32(x)) for x in centres[0]]
    rows += [(5_000 + k, same, 1) for k in range(n // 2)]  # a third of all rows are copies
    odd = [(7_000, None, 1), (7_001, [None] * dims, 0), (7_002, [float("nan")] * dims, 0), (7_003, [float("inf")] * dims, 0)]
    return rows + odd + [(None, rows[0][1], None), (rows[3][0], rows[3][1], 2), (rows[3][0], rows[4][1], 2)]


def result(df):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    return sorted((tuple(r) for r in df.collect()), key=key), key


@pytest.mark.parametrize(("dims", "entries", "block", "parts"), [(8, 16, 512, 4), (8, 16, 3, 4), (6, 40, 8, 4), (5, 300, 16, 2)])
def test_equals_plain_rounds(spark, monkeypatch, dims, entries, block, parts):
    monkeypatch.setattr(codes, "BLOCK", block)
    rows = vectors(random.Random(dims + entries), 120, dims)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found, key = result(vector_codes(df, parts=parts, entries=entries))
    expected = sorted(brute(rows, parts, entries, 4), key=key)
    if entries > 256:
        expected = sorted(((*r[:2], None, *r[3:]) for r in expected), key=key)
        found = sorted(((*r[:2], None, *r[3:]) for r in found), key=key)
    assert found == expected


def test_shortlist_keeps_every_nearest_entry():
    r = np.random.default_rng(5)
    for _ in range(200):
        points = r.integers(-40, 40, 3) + r.integers(0, 12, (20, 3))
        entries = r.integers(-50, 50, (30, 3))
        low, high = points.min(axis=0), points.max(axis=0)
        apart = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        near = shortlist(low, high, entries)
        assert set(np.nonzero(apart == apart.min(axis=1, keepdims=True))[1]) <= set(near)
        index, error = nearest(points, low, high, entries)
        assert (index == apart.argmin(axis=1)).all() and (error == apart.min(axis=1)).all()


def test_kernels_are_exact_beyond_floats():
    points = np.array([[1 << 29, -(1 << 29)], [(1 << 29) + 1, 3]], np.int64)
    entries = np.array([[-(1 << 29), 1 << 29], [7, -(1 << 29) + 1]], np.int64)
    wanted = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e)) for e in entries] for p in points]
    assert squared_distances(points, entries).tolist() == wanted
    with pytest.raises(OverflowError):
        squared_distances(points * 8, entries * 8)


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = hilbert_keys(cells, bits)
    assert len(set(keys)) == len(cells)
    along = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_many_labels_are_added_up_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(codes, "checked_broadcast", lambda df: df)
    rows = [(i, i % 7 if i % 5 else None, f"{i:02x}", i) for i in range(200)]
    found = with_label_errors(spark.createDataFrame(rows, "id long, label long, code string, error long")).collect()
    total = {}
    for _, label, _, error in rows:
        total[label] = total.get(label, 0) + error
    assert sorted((r.id, r.label_error) for r in found) == [(i, total[label]) for i, label, _, _ in rows]


def test_odd_tables(spark):
    assert vector_codes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vector_codes(spark.createDataFrame([(1, None, 2)], SCHEMA)).count() == 0
    rows = [(4, [0.5, -0.25, 1.0, 2.0], 1, 7, 8), (2, [0.5, -0.25, 1.0], None, 7, 8), (9, [], None, 7, 8)]
    df = spark.createDataFrame(rows, SCHEMA + ", row long, part int")
    found, key = result(vector_codes(df))
    assert found == sorted(brute([r[:3] for r in rows], 4, 256, 4), key=key)
    with pytest.raises(Exception, match="31 bits"):
        vector_codes(spark.createDataFrame([(1, [1e30], 1)], SCHEMA)).collect()
