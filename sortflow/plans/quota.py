"""Deterministic sampling without replacement: the first ``quota`` rows per key in hash order.

No row is moved to be ranked. Rows are counted per (key, hash prefix); the
prefix in which the quota runs out is looked up, only that prefix is ranked,
and the hash found there becomes a cut-off that every row is compared with.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sortflow.plans.broadcasting import checked_broadcast

DEFAULT_SEED = 42
PREFIX_DIGITS = 4


def hash_order(id_col: str, seed: int = DEFAULT_SEED) -> Column:
    """Sort key of a seeded shuffle, equal on every engine that has md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def hash_prefix(digest: Column) -> Column:
    return F.substring(digest, 1, PREFIX_DIGITS)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the keys are those of the left side."""
    named = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    return left.join(named, condition, how).drop(*[f"__right_{k}" for k in keys])


def pick_by_hash(
    df: DataFrame,
    key: str,
    id_col: str,
    quotas: DataFrame,
    flag: str = "picked",
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Flag the first ``quota`` rows of every key. ``quotas`` has (key, quota), one row per key.

    Keys without a quota get a null flag; null is a key like any other. ``id_col`` must be unique within a key.
    """
    quotas = checked_broadcast(quotas.select(key, F.col("quota").cast("bigint").alias("quota")))
    keyed = df.select(key, id_col, hash_order(id_col, seed).alias("__h")).withColumn(
        "__p", hash_prefix(F.col("__h"))
    )
    before = W.partitionBy(key).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    edges = (
        keyed.groupBy(key, "__p")
        .agg(F.count("*").alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .transform(lambda left: null_safe_join(left, quotas, [key]))
        .where("__before < quota and __before + __n >= quota")
        .select(key, "__p", (F.col("quota") - F.col("__before")).alias("__need"))
    )
    rank = F.row_number().over(W.partitionBy(key, "__p").orderBy("__h", id_col))
    cuts = (
        null_safe_join(keyed, checked_broadcast(edges), [key, "__p"])
        .withColumn("__rank", rank)
        .where("__rank = __need")
        .select(key, F.col("__h").alias("__cut_h"), F.col(id_col).alias("__cut_id"))
    )
    limits = checked_broadcast(null_safe_join(quotas, cuts, [key], "left"))
    h = hash_order(id_col, seed)
    inside = (h < F.col("__cut_h")) | ((h == F.col("__cut_h")) & (F.col(id_col) <= F.col("__cut_id")))
    return (
        null_safe_join(df, limits, [key], "left")
        .withColumn(
            flag,
            F.when(F.col("quota").isNull(), F.lit(None).cast("boolean"))
            .when(F.col("quota") <= 0, F.lit(False))
            .when(F.col("__cut_h").isNull(), F.lit(True))
            .otherwise(inside),
        )
        .drop("quota", "__cut_h", "__cut_id")
    )


def proportional_quotas(counts: DataFrame, key: str, draws: int) -> DataFrame:
    """Largest-remainder share of ``draws`` per key, from a small (key, n) table.

    Keys with equal remainders are served in key order.
    """
    whole = W.partitionBy()
    product = F.col("n").cast("decimal(19,0)") * F.lit(draws).cast("decimal(19,0)")
    shares = counts.withColumn("__total", F.sum(F.col("n").cast("decimal(19,0)")).over(whole))
    shares = shares.withColumn("__rest", (product % F.col("__total")).cast("decimal(38,0)"))
    shares = shares.withColumn(
        "__floor", ((product - F.col("__rest")) / F.col("__total")).cast("bigint")
    )
    missing = F.lit(draws) - F.sum("__floor").over(whole)
    place = F.row_number().over(W.orderBy(F.desc("__rest"), key))
    extra = (F.col("__place") <= F.col("__missing")) & (F.col("__rest") > 0)
    return (
        shares.withColumn("__missing", missing)
        .withColumn("__place", place)
        .select(key, "n", (F.col("__floor") + extra.cast("bigint")).alias("quota"))
    )
