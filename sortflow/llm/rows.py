"""Rows that pass through Python functions whole, next to the columns computed for them."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "row"


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no computed column can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW)


def text_of(df: DataFrame, column: str) -> Column:
    return F.col(f"`{column}`").cast("string")


def unpack(df: DataFrame, like: DataFrame) -> DataFrame:
    """The rows as they came, without what was computed."""
    return df.select(*[F.col(ROW)[c].alias(c) for c in like.columns])


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are gone: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
