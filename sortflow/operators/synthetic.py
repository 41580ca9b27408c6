"""Made-up corpus rows from templates, as expressions over a (label, index) table."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sortflow.functions.templates import (
    SEED_CHOICES,
    SEED_ROWS_PER_LABEL,
    SEED_TEMPLATES,
    SYNTHETIC_CHOICES,
    SYNTHETIC_RANGES,
    SYNTHETIC_TEMPLATES,
)
from sortflow.functions.vocabulary import SEED

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def fill(template: str, values: Mapping[str, Column]) -> Column:
    """The template with its known ``{name}`` placeholders replaced; other braces stay."""
    parts, end = [], 0
    for match in _PLACEHOLDER.finditer(template):
        if match[1] in values:
            parts += [F.lit(template[end : match.start()]), values[match[1]].cast("string")]
            end = match.end()
    return F.concat(*parts, F.lit(template[end:]))


def seeded_choice(seed: int, label: str, slot: str, index: Column, size: int) -> Column:
    """A number in [0, size) fixed by seed, label, slot and row index."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{label}:{slot}:"), index.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(size))


def _item(items: list[str], position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), (position + 1).cast("int"))


def cents_text(cents: Column) -> Column:
    """Amount text with one or two decimals: no trailing zero beyond the first decimal."""
    whole, rest = F.floor(cents / 100), F.pmod(cents, F.lit(100))
    decimals = F.when(rest % 10 == 0, (rest / 10).cast("bigint").cast("string")).otherwise(
        F.lpad(rest.cast("string"), 2, "0")
    )
    return F.concat(whole.cast("string"), F.lit("."), decimals)


def _synthetic_values(label: str, index: Column, seed: int) -> dict[str, Column]:
    values = {"index": index}
    for slot, items in SYNTHETIC_CHOICES.get(label, {}).items():
        values[slot] = _item(items, seeded_choice(seed, label, slot, index, len(items)))
    for slot, (low, high) in SYNTHETIC_RANGES.get(label, {}).items():
        values[slot] = F.lit(low) + seeded_choice(seed, label, slot, index, high - low + 1)
    if label == "Finance":
        amount = values["amount"]
        tax_cents = amount * 13
        values |= {
            "index4": F.format_string("%04d", index),
            "subtotal": amount - 120,
            "tax": cents_text(tax_cents),
            "net": cents_text(amount * 100 - tax_cents + 500_000),
            "half": F.floor(amount / 2),
        }
    if label == "Logs":
        values |= {
            "day2": F.format_string("%02d", values["day"]),
            "index5": F.format_string("%05d", index),
        }
    return values


def synthetic_rows(df: DataFrame, label: str, index: str, seed: int = SEED) -> DataFrame:
    """Add filename and content to every row with a known label; rows with other labels go."""
    filename, content = F.lit(None).cast("string"), F.lit(None).cast("string")
    idx = F.col(index)
    for name, templates in SYNTHETIC_TEMPLATES.items():
        values = _synthetic_values(name, idx, seed)
        option = seeded_choice(seed, name, "template", idx, len(templates))
        for position, (file_template, text_template) in enumerate(templates):
            here = (F.col(label) == name) & (option == position)
            filename = F.when(here, fill(file_template, values)).otherwise(filename)
            content = F.when(here, fill(text_template, values)).otherwise(content)
    known = df.where(F.col(label).isin(list(SYNTHETIC_TEMPLATES)))
    return known.withColumn("filename", filename).withColumn("content", content)


def counted_indexes(spark: SparkSession, counts: Mapping[str, int]) -> DataFrame:
    """(label, index) with ``counts[label]`` rows per label, generated in parallel from one range."""
    bounds, total = [], 0
    for label, count in counts.items():
        if count > 0:
            bounds.append((label, total, total + count))
            total += count
    label = F.lit(None).cast("string")
    start = F.lit(0).cast("bigint")
    for name, low, high in bounds:
        here = (F.col("id") >= low) & (F.col("id") < high)
        label = F.when(here, name).otherwise(label)
        start = F.when(here, F.lit(low).cast("bigint")).otherwise(start)
    return spark.range(total).select(label.alias("label"), (F.col("id") - start).alias("index"))


def synthetic_corpus(spark: SparkSession, counts: Mapping[str, int], seed: int = SEED) -> DataFrame | None:
    """Made-up rows per label; unknown labels and counts of 0 or less give none."""
    wanted = {k: int(v) for k, v in counts.items() if k in SYNTHETIC_TEMPLATES and int(v) > 0}
    if not wanted:
        return None
    return synthetic_rows(counted_indexes(spark, wanted), "label", "index", seed)


def seed_rows(df: DataFrame, label: str, index: str) -> DataFrame:
    """Add filename and content of the Russian seed corpus; texts follow the index alone."""
    filename, content = F.lit(None).cast("string"), F.lit(None).cast("string")
    idx = F.col(index)
    for name, (file_template, text_template) in SEED_TEMPLATES.items():
        values = {"index": idx}
        for slot, items in SEED_CHOICES[name].items():
            values[slot] = _item(items, F.pmod(idx, F.lit(len(items))))
        if name == "Finance":
            words = F.translate(values["name"], "_", " ")
            amount = F.lit(15_000).cast("bigint") + idx * 137
            values |= {
                "title": F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substring(words, 2, 1000))),
                "number": F.lit(1000) + idx,
                "amount": amount,
                "vat": cents_text(amount * 20),
            }
        here = F.col(label) == name
        filename = F.when(here, fill(file_template, values)).otherwise(filename)
        content = F.when(here, fill(text_template, values)).otherwise(content)
    known = df.where(F.col(label).isin(list(SEED_TEMPLATES)))
    return known.withColumn("filename", filename).withColumn("content", content)


def seed_corpus(spark: SparkSession, rows_per_label: int = SEED_ROWS_PER_LABEL) -> DataFrame:
    indexes = spark.range(rows_per_label).select(
        F.col("id").alias("index"), F.explode(F.array(*[F.lit(x) for x in SEED_TEMPLATES])).alias("label")
    )
    return seed_rows(indexes, "label", "index")
