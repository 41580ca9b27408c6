"""Broadcast joins whose small side is measured first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 10_000


def checked_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Return ``df`` marked for broadcast if it has at most ``max_rows`` rows, else unmarked.

    The check reads at most ``max_rows + 1`` rows and, when it holds, the rows
    read are the broadcast itself, so the aggregation behind ``df`` runs once.
    Meant for narrow dimension rows: labels, quotas, cut-offs, counts.
    """
    head = df.limit(max_rows + 1).toArrow()
    if head.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(head, df.schema))


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A broadcastable literal table of fixed size, held in the program itself."""
    return F.broadcast(spark.createDataFrame(rows, schema))
