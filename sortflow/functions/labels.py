"""Category look-ups and confidence expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from sortflow.functions.vocabulary import (
    CATEGORY_ICONS,
    DEFAULT_CATEGORY,
    HIGH_CONFIDENCE,
    MEDIUM_CONFIDENCE,
    REJECT_THRESHOLD,
)


def category_icon(category: Column) -> Column:
    icons = F.create_map(*[F.lit(x) for x in chain.from_iterable(CATEGORY_ICONS.items())])
    return F.coalesce(F.try_element_at(icons, category), F.lit(CATEGORY_ICONS[DEFAULT_CATEGORY]))


def confidence_band(confidence: Column) -> Column:
    return (
        F.when(confidence >= HIGH_CONFIDENCE, "high")
        .when(confidence >= MEDIUM_CONFIDENCE, "medium")
        .otherwise("low")
    )


def reject_low(category: Column, confidence: Column, threshold: float = REJECT_THRESHOLD) -> Column:
    """The category, or the default one below the threshold; compares the unrounded confidence."""
    return F.when(confidence < threshold, DEFAULT_CATEGORY).otherwise(category)


def softmax(logits: Column) -> Column:
    """Class probabilities of an array of scores, shifted by the maximum against overflow."""
    # Row-wide values enter the lambdas as repeated arrays: inside, they would be worked out per element.
    n = F.size(logits)
    peak = F.array_repeat(F.array_max(logits).cast("double"), n)
    scaled = F.zip_with(logits, peak, lambda x, m: F.exp(x.cast("double") - m))
    total = F.array_repeat(F.aggregate(scaled, F.lit(0.0), lambda acc, x: acc + x), n)
    return F.zip_with(scaled, total, lambda x, t: x / t)


def arg_max(values: Column) -> Column:
    """0-based position of the first maximum."""
    return F.array_position(values, F.array_max(values)) - 1
