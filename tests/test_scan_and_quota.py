from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sortflow.operators import corpus
from sortflow.plans.broadcasting import checked_broadcast
from sortflow.plans.quota import pick_by_hash, proportional_quotas
from sortflow.plans.scan import Running, next_value, running


def skewed_rows(seed=1, n=400):
    """One key holds most rows, ids have gaps."""
    rng = random.Random(seed)
    ids = sorted(rng.sample(range(n * 3), n))
    return [(i, "hot" if rng.random() < 0.7 else rng.choice("abc"), rng.randint(-9, 9)) for i in ids]


def test_running_aggregates_cross_chunks(spark):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "id bigint, k string, v int").repartition(5)
    scanned = running(
        df, ["k"], ["id"], F.expr("id div 7"),
        Running("s", "sum", F.col("v")), Running("m", "max", F.col("v"), inclusive=False), Running("l", "min", F.col("v")),
    )
    got = {r.id: (r.s, r.m, r.l) for r in scanned.collect()}
    seen: dict[str, list[int]] = {}
    for i, k, v in rows:
        before = seen.setdefault(k, [])
        assert got[i] == (sum(before) + v, max(before) if before else None, min([*before, v]))
        before.append(v)


def test_next_value_crosses_chunks(spark):
    rows = skewed_rows(2)
    df = spark.createDataFrame(rows, "id bigint, k string, v int")
    got = {r.id: r.n for r in next_value(df, ["k"], "id", F.expr("id div 5"), "v", "n").collect()}
    following: dict[str, int] = {}
    for i, k, v in reversed(rows):
        assert got[i] == following.get(k)
        following[k] = v


def test_null_key_is_an_error(spark):
    df = spark.createDataFrame([(1, None)], "id bigint, k string")
    with pytest.raises(Exception, match="Null in key column"):
        running(df, ["k"], ["id"], F.expr("id div 5"), Running("n", "sum", F.lit(1))).collect()


def by_hash(ids, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("quota", [0, 1, 17, 280, 10_000])
def test_pick_takes_the_first_in_hash_order(spark, quota):
    rows = skewed_rows(3)
    df = spark.createDataFrame([(i, k) for i, k, _ in rows], "id bigint, k string")
    quotas = spark.createDataFrame([("hot", quota), ("a", 3)], "k string, quota int")
    got = pick_by_hash(df, "k", "id", quotas).collect()
    hot = [i for i, k, _ in rows if k == "hot"]
    assert {r.id for r in got if r.k == "hot" and r.picked} == set(by_hash(hot)[:quota])
    assert sum(r.picked for r in got if r.k == "a") == 3
    assert {r.picked for r in got if r.k in "bc"} == {None}


def test_quotas_share_the_remainder(spark):
    counts = spark.createDataFrame([("de", 129), ("en", 620), ("es", 106), ("fr", 145)], "k string, n bigint")
    got = {r.k: r.quota for r in proportional_quotas(counts, "k", 800).collect()}
    assert got == {"de": 103, "en": 496, "es": 85, "fr": 116}
    ties = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, n bigint")
    assert {r.k: r.quota for r in proportional_quotas(ties, "k", 2).collect()} == {"a": 1, "b": 1, "c": 0}


@pytest.mark.parametrize(("total", "held_out"), [(6484, 1297), (6946, 1390)])
def test_split_sizes(spark, total, held_out):
    df = spark.range(total).select("id", F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("label"))
    counts = {(r.split): r["count"] for r in corpus.stratified_split(df, "label", "id").groupBy("split").count().collect()}
    assert counts == {"validation": held_out, "train": total - held_out}


def test_cap_keeps_proportions_and_checks_classes(spark):
    df = spark.range(100).select("id", F.concat(F.lit("c"), (F.col("id") % 4).cast("string")).alias("label"))
    assert corpus.stratified_cap(df, "label", "id", 0).count() == 100
    assert corpus.stratified_cap(df, "label", "id", 100).count() == 100
    sizes = {r.label: r["count"] for r in corpus.stratified_cap(df, "label", "id", 10).groupBy("label").count().collect()}
    assert sum(sizes.values()) == 10 and set(sizes.values()) == {2, 3}
    with pytest.raises(ValueError, match="cannot hold"):
        corpus.stratified_cap(df, "label", "id", 3)


def test_large_side_is_not_broadcast(spark):
    plan = checked_broadcast(spark.range(50), max_rows=10)
    assert "ResolvedHint" not in plan._jdf.queryExecution().analyzed().toString()
    small = checked_broadcast(spark.range(5), max_rows=10)
    assert "ResolvedHint" in small._jdf.queryExecution().analyzed().toString()
    assert small.count() == 5
