"""Expressions that are computed once per row, however often their result is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """(keep, columns): costly columns whose later filters do not repeat the work.

    The optimizer moves a filter on a computed column below the projection and
    so evaluates the expression twice. A one-element generator stops that.
    """
    packed = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select(*keep, F.inline(packed))
