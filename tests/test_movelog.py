from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sortflow.operators import movelog as ops

OPS = "id bigint, owner string, op string, category string"


def naive_replay(rows):
    stacks: dict[str, list[int]] = {}
    undone: dict[int, int] = {}
    for i, owner, op, _ in rows:
        stack = stacks.setdefault(owner, [])
        if op == "move":
            stack.append(i)
            undone[i] = 0
        elif op == "undo" and stack:
            undone[stack.pop()] = 1
    return undone


@pytest.mark.parametrize("seed", range(3))
def test_replay_equals_a_stack(spark, small_chunks, seed):
    rng = random.Random(seed)
    rows = [
        (i, "hot" if rng.random() < 0.6 else rng.choice("ab"), rng.choice(["move", "undo", "undo_failed"] + ["move"] * seed), "Docs")
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, OPS).repartition(6)
    assert {r.id: r.undone for r in ops.undo_replay(df).collect()} == naive_replay(rows)


def test_second_undo_of_one_move_does_nothing(spark):
    rows = [(1, "o", "move", "Docs"), (2, "o", "undo", None), (3, "o", "undo", None), (4, "o", "move", "Code")]
    got = ops.undo_replay(spark.createDataFrame(rows, OPS))
    assert {r.id: r.undone for r in got.collect()} == {1: 1, 4: 0}


def moves(spark):
    rows = [(i, "o1" if i % 2 else "o2", f"/in/f{i}.txt", f"/out/f{i}.txt", "Docs" if i < 5 else "Code", i / 16, int(i >= 8)) for i in range(1, 11)]
    return spark.createDataFrame(rows, "id bigint, owner string, src string, dst string, category string, confidence double, undone int").withColumn("ts", F.current_timestamp())


def test_views(spark):
    log = moves(spark)
    assert {r.owner: r.id for r in ops.last_live_move(log).collect()} == {"o1": 7, "o2": 6}
    assert [r.id for r in ops.recent_moves(log, 3).collect()] == [10, 9, 8]
    flagged = ops.recent_moves_flagged(log, 5).collect()
    assert [(r.id, r.can_undo) for r in flagged] == [(10, False), (9, False), (8, False), (7, True), (6, False)]
    # A live move beyond the page cannot be undone from it.
    assert not any(r.can_undo for r in ops.recent_moves_flagged(log, 3).collect())
    assert {r.category: r["count"] for r in ops.category_stats(log).collect()} == {"Docs": 4, "Code": 3}
    board = [(r.category, r["count"]) for r in ops.dashboard_counts(log).collect()]
    assert board[:2] == [("Code", 3), ("Docs", 4)] and len(board) == 8 and sum(n for _, n in board) == 7
    shown = ops.log_view(log).where("id = 2").first()
    assert (shown.filename, shown.confidence_text) == ("f2.txt", f"{2 / 16:.0%}")
    assert [r.id for r in ops.result_feed(log, "id", 2).collect()] == [10, 9]


def test_route_status_uses_the_rounded_confidence(spark):
    rows = [(0.55, True, False), (0.549, True, False), (0.9, False, False), (0.9, True, True)]
    df = spark.createDataFrame(rows, "c double, auto boolean, failed boolean")
    status = ops.route_status(F.col("c"), F.col("auto"), F.col("failed"))
    assert [r.s for r in df.select(status.alias("s")).collect()] == ["Moved", "Skipped (< 0.55)", "Pending", "Error"]


def test_apply_all_leaves_skipped_rows(spark):
    df = spark.createDataFrame([("Pending", 0.9), ("Pending", 0.1), ("Skipped (< 0.55)", 0.9)], "status string, confidence double")
    assert [r.status for r in ops.apply_all_pending(df).collect()] == ["Moved", "Skipped (< 0.55)", "Skipped (< 0.55)"]


def test_appends_number_on_and_replays_leave_one_copy(spark, tmp_path, small_chunks):
    path = str(tmp_path / "log")
    assert ops.read_moves(spark, path).count() == 0
    first = moves(spark).select("id", "src", "dst", "category", "confidence")
    ops.append_moves(path, first, "id", "0")
    for _ in range(2):
        ops.append_moves(path, first.where("id <= 3"), "id", "1")
    log = ops.read_moves(spark, path)
    assert sorted(r.id for r in log.collect()) == list(range(1, 14))
    assert {r.src for r in log.where("id > 10").collect()} == {"/in/f1.txt", "/in/f2.txt", "/in/f3.txt"}
    assert log.where("undone = 0 and ts is not null").count() == 13


@pytest.mark.parametrize("seed", range(2))
def test_snapshots_equal_a_replay_of_the_whole_log(spark, tmp_path, monkeypatch, small_chunks, seed):
    monkeypatch.setattr(ops, "CHUNK_ROWS", 3)
    rng, path = random.Random(seed), str(tmp_path / "log")
    schema = "n long, op string, owner string, src string, dst string, category string, confidence double"
    at = 0
    for batch in range(5):
        rows = [(at + i, rng.choice(["move", "undo"] if batch % 2 else ["move", "move", "undo"]), rng.choice([None, "a", "b"]), f"s{at + i}", None, "Docs", 0.5) for i in range(20)]
        at += 20
        for _ in range(2):
            ops.append_operations(path, spark.createDataFrame(rows, schema), "n", f"b{batch}")
        if batch in (0, 2, 3):
            assert ops.fold_log(spark, path) and not ops.fold_log(spark, path)
            ops.append_operations(path, spark.createDataFrame(rows, schema), "n", f"b{batch}")
        whole = {(r.id, r.src) for r in ops.read_moves(spark, path).where("undone = 0").collect()}
        assert {(r.id, r.src) for r in ops.live_moves(spark, path).collect()} == whole
    assert ops.snapshot(spark, path).last == 80 and ops.snapshot(spark, path).batches == {"b0", "b1", "b2", "b3"}


def test_a_fold_that_was_cut_off_does_not_count(spark, tmp_path):
    path = str(tmp_path / "log")
    assert not ops.fold_log(spark, path) and ops.live_moves(spark, path).count() == 0
    ops.append_moves(path, moves(spark).drop("owner"), "id", "0")
    ops.fold_log(spark, path)
    (tmp_path / "log-live" / "version=1" / "moves").mkdir(parents=True)
    assert ops.snapshot(spark, path).version == 0 and ops.live_moves(spark, path).count() == 10
    ops.append_undo(spark, path, "undo")
    assert ops.fold_log(spark, path) and ops.snapshot(spark, path).version == 1
    assert ops.live_moves(spark, path).agg(F.max("id")).first()[0] == 9
