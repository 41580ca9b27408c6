"""Ordered scans over keys of any size.

A plain window puts one key into one task. Here a key is cut into ordered
chunks: every chunk is scanned on its own, each chunk leaves one summary row,
the summaries are scanned per key, and the result is carried back into the
chunks. A task then holds at most one chunk, whatever the key distribution.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK_ROWS = 65_536
CHUNK = "__chunk"


def id_chunk(id_col: str, rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of a unique integer id: ids are distinct, so a chunk holds at most ``rows`` of them."""
    return F.expr(f"`{id_col}` div {rows}")


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``how`` is sum, min or max; exclusive ones stop before the current row."""

    name: str
    how: str
    value: Column
    inclusive: bool = True


_AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max}


def _merge(how: str, local: Column, carry: Column) -> Column:
    if how == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    return F.least(local, carry) if how == "min" else F.greatest(local, carry)


def chunked(df: DataFrame, keys: Sequence[str], chunk: Column) -> DataFrame:
    """Add the chunk number, and fail on null keys: they would not meet in the join of :func:`carry_join`."""
    for k in keys:
        df = df.withColumn(k, F.coalesce(F.col(k), F.raise_error(f"Null in key column {k}")))
    return df.withColumn(CHUNK, chunk)


def carry_join(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join per-chunk carries to their rows. The rows lie by (keys, chunk) already and are not moved again."""
    return rows.join(carry, [*keys, CHUNK], "left")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    *specs: Running,
) -> DataFrame:
    """Add running aggregates per key in ``order``. ``chunk`` must not decrease along ``order``."""
    source = chunked(df, keys, chunk)
    rows = source
    base = W.partitionBy(*keys, CHUNK).orderBy(*order)
    totals = []
    for spec in specs:
        aggregate = _AGGREGATES[spec.how]
        end = W.currentRow if spec.inclusive else -1
        rows = rows.withColumn(
            spec.name, aggregate(spec.value).over(base.rowsBetween(W.unboundedPreceding, end))
        )
        totals.append(aggregate(spec.value).alias(f"__{spec.name}"))
    earlier = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    carry = (
        source.groupBy(*keys, CHUNK)
        .agg(*totals)
        .select(
            *keys,
            CHUNK,
            *[_AGGREGATES[s.how](f"__{s.name}").over(earlier).alias(f"__{s.name}") for s in specs],
        )
    )
    joined = carry_join(rows, carry, keys)
    for spec in specs:
        joined = joined.withColumn(
            spec.name, _merge(spec.how, F.col(spec.name), F.col(f"__{spec.name}"))
        )
    return joined.drop(CHUNK, *[f"__{s.name}" for s in specs])


def dense_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, name: str
) -> DataFrame:
    """Add the 0-based position of every row within its key."""
    return running(
        df, keys, order, chunk, Running(name, "sum", F.lit(1).cast("bigint"), inclusive=False)
    )


def next_value(
    df: DataFrame, keys: Sequence[str], order: str, chunk: Column, value: str, name: str
) -> DataFrame:
    """Add the ``value`` of the following row of the same key. ``value`` itself must not be null."""
    source = chunked(df, keys, chunk)
    rows = source
    base = W.partitionBy(*keys, CHUNK).orderBy(order)
    rows = rows.withColumn(name, F.lead(value).over(base))
    later = W.partitionBy(*keys).orderBy(CHUNK)
    carry = (
        source.groupBy(*keys, CHUNK)
        .agg(F.min_by(value, order).alias("__first"))
        .select(*keys, CHUNK, F.lead("__first").over(later).alias("__carried"))
    )
    joined = carry_join(rows, carry, keys)
    return joined.withColumn(name, F.coalesce(name, "__carried")).drop(CHUNK, "__carried")
