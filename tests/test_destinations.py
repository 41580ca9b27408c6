from __future__ import annotations

import random
from pathlib import PurePosixPath

import numpy as np
import pytest

from sortflow.operators.destinations import _NO_LIMIT, plan_destinations, thresholds

NAMES = ["a.txt", "a_1.txt", "a_2.txt", "a_1_1.txt", "b", "b_1", "a.tar.gz", "a.tar_1.gz", "a_01.txt", ".env", ".env_1"]


def sequential(files, existing):
    """The rule, one file after another."""
    used = set(existing)
    out = {}
    for seq, category, name in sorted(files):
        path, target, k = PurePosixPath(name), name, 0
        while (category, target) in used:
            k += 1
            target = f"{path.stem}_{k}{path.suffix}"
        used.add((category, target))
        out[seq] = f"/out/{category}/{target}"
    return out


def planned(spark, files, existing):
    df = spark.createDataFrame(files, "seq bigint, category string, name string")
    disk = spark.createDataFrame(existing, "category string, name string") if existing else None
    return {r.seq: r.destination for r in plan_destinations(df, "/out", disk).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_contending_names_follow_the_sequential_rule(spark, small_chunks, seed):
    rng = random.Random(seed)
    names = NAMES if seed % 2 else NAMES[:4]
    files = [(i, rng.choice(["Docs", "Code"]), rng.choice(names)) for i in range(120)]
    existing = sorted({("Docs", rng.choice(names + ["a_3.txt", "a_4.txt", "a_7.txt"])) for _ in range(seed * 3)})
    rng.shuffle(files)
    assert planned(spark, files, existing) == sequential(files, existing)


@pytest.mark.parametrize("seed", range(3))
def test_chunks_are_functions_of_what_was_skipped_before(seed):
    """The thresholds of a chunk give what a walk gives, from any start."""
    rng = random.Random(seed)
    lengths = np.array([rng.choice([1, 1, 1, 5]) for _ in range(300)])
    limits = np.array([_NO_LIMIT if n > 1 or rng.random() < 0.2 else rng.randrange(-5, 250) for n in lengths])
    added, found = thresholds(lengths, limits)
    assert found == sorted(found)
    for start in [0, 1, 2, 7, 30, 90, 150, 240, 400]:
        y = start
        for length, limit in zip(lengths.tolist(), limits.tolist()):
            y += length * (y <= limit)
        assert start + added + sum(t >= start for t in found) == y


@pytest.mark.parametrize("seed", range(3))
def test_a_deep_family_in_chunks(spark, small_chunks, seed):
    """Names that are slots of slots of slots, some on disk: whether a name's own slot is gone is known from its parents."""
    rng = random.Random(40 + seed)
    names = ["".join(["n", *rng.choices(["_1", "_2", "_3"], k=rng.randrange(4))]) + ".txt" for _ in range(60)]
    files = [(i, "Docs", rng.choice(names)) for i in range(150)]
    existing = [("Docs", n) for n in rng.sample(sorted(set(names)), 4)]
    assert planned(spark, files, existing) == sequential(files, existing)


def test_a_family_of_numbered_names_in_chunks(spark, small_chunks):
    rng = random.Random(3)
    files = [(i, "Docs", "n.txt" if rng.random() < 0.5 else f"n_{rng.randrange(1, 90)}.txt") for i in range(200)]
    assert planned(spark, files, []) == sequential(files, [])


def test_long_run_on_disk_is_passed(spark, small_chunks):
    existing = [("Docs", "a.txt")] + [("Docs", f"a_{k}.txt") for k in range(1, 40) if k != 17]
    files = [(i, "Docs", "a.txt") for i in range(4)] + [(9, "Docs", "a_40.txt"), (2 + 100, "Docs", "a_41.txt")]
    assert planned(spark, files, existing) == sequential(files, existing)


def test_free_folder_numbers_in_order(spark, small_chunks):
    files = [(i, "Docs", "x.tar.gz") for i in range(10)]
    result = planned(spark, files, [])
    assert result == sequential(files, [])
    assert result[3] == "/out/Docs/x.tar_3.gz"
