"""Building the labelled corpus: normalise, filter, deduplicate, sample, rebalance, split."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sortflow.functions.paths import bounded_name, ensure_filename
from sortflow.functions.text import normalize_text, normalize_value, present_fields
from sortflow.functions.vocabulary import (
    CATEGORIES,
    DEFAULT_CATEGORY,
    MAX_CONTENT_CHARS,
    NAME_PREFIX_CHARS,
    SEED,
    SELF_SUPPLIED_LABELS,
)
from sortflow.operators.synthetic import synthetic_corpus
from sortflow.plans.broadcasting import checked_broadcast, dimension
from sortflow.plans.once import computed_once
from sortflow.plans.quota import hash_order, hash_prefix, pick_by_hash, proportional_quotas
from sortflow.plans.scan import dense_index, id_chunk
from sortflow.plans.workspace import materialise
from sortflow.sources.manifest import LOCAL, Manifest, SourceSpec
from sortflow.sources.tables import CORPUS_COLUMNS, fill_nulls, load_table

log = logging.getLogger(__name__)

#: Conditions of a job that failed because a file could not be read.
READ_CONDITIONS = (
    "CANNOT_MERGE_SCHEMAS", "CANNOT_READ_FILE_FOOTER", "CONVERTING_AVRO", "FAILED_READ_FILE", "MALFORMED_CSV_RECORD",
    "MALFORMED_RECORD_IN_PARSING", "PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA",
)

ROW_ORDER = "__order"
ROW_INDEX = "row_index"


# --- rows of one source ---------------------------------------------------------------------------


def matches_filters(df: DataFrame, filters: Mapping[str, object]) -> Column:
    """All filters hold, comparing normalised text without case; a column that is absent matches nothing."""
    fields = {f.name.lower(): f for f in df.schema.fields}
    conditions = [F.lit(True)]
    for name, wanted in filters.items():
        spec = fields.get(name.lower())
        if spec is None:
            return F.lit(False)
        # Numbers and booleans of the manifest follow the same text rule as data cells.
        text = "" if not wanted else str(wanted)
        actual = F.lower(normalize_value(F.col(f"`{spec.name}`"), spec.dataType))
        conditions.append(actual == F.lower(normalize_text(F.lit(text))))
    return reduce(lambda a, b: a & b, conditions)


def drop_full_row_duplicates(df: DataFrame) -> DataFrame:
    """Exact duplicates of whole rows; copies meet in a map-side aggregate first, so a hot row shuffles once per task."""
    return df.dropDuplicates()


def sample_rows(df: DataFrame, id_col: str, limit: int, seed: int = SEED) -> DataFrame:
    """At most ``limit`` rows, a seeded uniform choice without replacement; 0 keeps all."""
    if limit <= 0:
        return df
    keyed = df.withColumn("__all", F.lit(0))
    quotas = dimension(df.sparkSession, [(0, limit)], "__all int, quota bigint")
    return pick_by_hash(keyed, "__all", id_col, quotas, "__picked", seed).where("__picked").drop("__all", "__picked")


def sample_per_source(df: DataFrame, source: str, id_col: str, limit: int, seed: int = SEED) -> DataFrame:
    """At most ``limit`` rows of every source."""
    quotas = df.select(source).distinct().withColumn("quota", F.lit(limit))
    return pick_by_hash(df, source, id_col, quotas, "__picked", seed).where("__picked").drop("__picked")


def source_rows(
    df: DataFrame,
    spec: SourceSpec,
    seed: int = SEED,
    max_chars: int | None = MAX_CONTENT_CHARS,
) -> DataFrame:
    """Corpus rows of one raw table: (filename, content, label).

    Row order is that of ``spec.id_column``; without one, rows are ordered by
    a digest of the whole row, which is unique once full-row copies are gone.
    """
    rows = fill_nulls(df).where(matches_filters(df, spec.filters))
    if spec.id_column is not None:
        rows = rows.withColumn(ROW_ORDER, F.col(spec.id_column))
        chunk = id_chunk(ROW_ORDER)
    elif spec.drop_duplicates:
        rows = drop_full_row_duplicates(rows)
        rows = rows.withColumn(ROW_ORDER, F.md5(F.to_json(F.struct(*[f"`{c}`" for c in df.columns]))))
        chunk = hash_prefix(F.col(ROW_ORDER))
    else:
        raise ValueError(f"Source {spec.name} keeps duplicate rows and so needs an id_column.")
    if spec.sample_limit > 0 and spec.id_column is None:
        rows = materialise(rows, "source-digests")  # drawing reads the digests several times
    rows = sample_rows(rows, ROW_ORDER, spec.sample_limit, seed)

    # Each column is normalised once, whether it serves the name, the content, or both.
    used = {f.name: f for f in present_fields(df, [*spec.filename_columns, *spec.content_columns])}
    cells = {f"__{name}": F.nullif(normalize_value(F.col(f"`{name}`"), f.dataType), F.lit("")) for name, f in used.items()}
    rows = computed_once(rows, [ROW_ORDER], cells) if cells else rows.select(ROW_ORDER)

    def found(candidates: tuple[str, ...]) -> list[Column]:
        return [F.col(f"`__{f.name}`") for f in present_fields(df, candidates)]

    name = F.coalesce(*found(spec.filename_columns), F.lit(""))
    if spec.filename_from_content_prefix:
        prefix = F.substring(F.coalesce(*found(spec.content_columns), F.lit("")), 1, NAME_PREFIX_CHARS)
        name = F.when(name == "", prefix).otherwise(name)
    content = F.concat_ws(" ", *found(spec.content_columns))
    rows = rows.select(ROW_ORDER, name.alias("filename"), content.alias("content"), F.lit(spec.label).alias("label"))
    # The source is read and normalised here, once; names and positions come from the written table.
    rows = name_rows(materialise(rows, "source-normalised"), chunk, spec)
    if max_chars is not None:
        rows = rows.withColumn("content", F.substring("content", 1, max_chars))
    return dedup_keyed(rows, [], ROW_ORDER)


def name_rows(rows: DataFrame, chunk: Column, spec: SourceSpec) -> DataFrame:
    """Drop short rows and make up the missing file names.

    A made-up name holds the row's position among all rows read, short ones
    included. Positions are worked out on the order column alone and joined to
    the nameless rows, so rows that have a name are not moved for it. A source
    that names rows after their content has no nameless row left to keep.
    """
    filename = F.col("filename")
    long_enough = min_content(rows, spec.min_content_length)
    named = long_enough.where(filename != "").withColumn("filename", bounded_name(filename))
    if spec.filename_from_content_prefix and spec.min_content_length > 0:
        return named
    positions = dense_index(
        rows.select(ROW_ORDER, (filename == "").alias("__nameless")), [], [ROW_ORDER], chunk, ROW_INDEX
    )
    nameless = long_enough.where(filename == "").join(
        positions.where("__nameless").select(ROW_ORDER, ROW_INDEX), ROW_ORDER
    )
    made_up = nameless.withColumn("filename", ensure_filename(filename, F.col("label"), F.col(ROW_INDEX)))
    return named.unionByName(made_up.drop(ROW_INDEX))


def min_content(df: DataFrame, length: int, column: str = "content") -> DataFrame:
    return df.where(F.char_length(column) >= length)


def dedup_keyed(df: DataFrame, source_keys: list[str], order: str) -> DataFrame:
    """Keep the first row of each (source, filename, content, label).

    Every output column is a group key except the order, so this is one
    aggregate with map-side combine: copies of one row collapse before the
    shuffle and no group is ever gathered.
    """
    keys = [*source_keys, *CORPUS_COLUMNS]
    return df.groupBy(*keys).agg(F.min(order).alias(order))


# --- many sources ---------------------------------------------------------------------------------

Reader = Callable[[SparkSession, SourceSpec], DataFrame]


def read_local(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    return load_table(spark, spec.path, spec.format)


@dataclass(frozen=True)
class SourceLoad:
    """Outcome of reading one manifest entry: the rows, or why there are none."""

    name: str
    label: str
    rows: DataFrame | None
    error: str | None = None


def unreadable(failure: Exception) -> bool:
    """Whether ``failure`` says that a source cannot be read as declared. A job that failed for another reason does not."""
    if isinstance(failure, (ValueError, OSError, AnalysisException)):
        return True
    return any(f"[{condition}" in str(failure) for condition in READ_CONDITIONS)


def load_sources(
    spark: SparkSession,
    manifest: Manifest,
    readers: Mapping[str, Reader] | None = None,
    max_chars: int | None = MAX_CONTENT_CHARS,
    seed: int = SEED,
) -> list[SourceLoad]:
    """Read every source once and write its rows. A source that cannot be read is skipped, unless it is required.

    Any other failure ends the build. Kinds other than local files need a reader of their own in ``readers``.
    """
    known = {LOCAL: read_local, **(readers or {})}
    loads = []
    for entry in manifest.sources:
        spec_name, label, required = "?", "unknown", False
        try:
            raw = entry if isinstance(entry, SourceSpec) else None
            if raw is None:
                spec_name = entry.get("dataset") or entry.get("path") or entry.get("label")
                label, required = entry.get("label", "unknown"), bool(entry.get("required", False))
                raw = SourceSpec.from_dict(entry)
            spec_name, label, required = raw.name, raw.label, raw.required
            if raw.kind not in known:
                raise ValueError(f"No reader for sources of kind {raw.kind}")
            rows = source_rows(known[raw.kind](spark, raw), raw, seed, max_chars)
            loads.append(SourceLoad(spec_name, label, materialise(rows, "source")))
        except (PySparkException, Py4JJavaError, ValueError, OSError) as exc:
            if not unreadable(exc):
                raise
            if required:
                raise RuntimeError(f"Required source failed: {spec_name}") from exc
            log.warning("Skipped source %s: %s", spec_name, exc)
            loads.append(SourceLoad(spec_name, label, None, f"{type(exc).__name__}: {str(exc).partition(chr(10))[0]}"))
    return loads


def union_sources(loads: list[SourceLoad]) -> DataFrame:
    """(source, corpus columns, row_key) of all sources. Keys tell apart entries that read the same table."""
    frames = [
        load.rows.select(
            F.lit(load.name).alias("source"),
            *CORPUS_COLUMNS,
            F.concat_ws(":", F.lit(position), F.col(ROW_ORDER).cast("string")).alias("row_key"),
        )
        for position, load in enumerate(loads)
        if load.rows is not None
    ]
    if not frames:
        raise ValueError("None of the declared sources could be read.")
    return reduce(DataFrame.unionByName, frames)


def source_audit(spark: SparkSession, loads: list[SourceLoad]) -> DataFrame:
    """Rows kept per source, with a zero row for sources that were skipped or came out empty."""
    declared = dimension(
        spark,
        [(i, load.name, load.label, "skipped" if load.rows is None else "loaded") for i, load in enumerate(loads)],
        "position int, source string, label string, status string",
    )
    counted = [
        load.rows.agg(F.count("*").alias("rows")).withColumn("position", F.lit(i))
        for i, load in enumerate(loads)
        if load.rows is not None
    ]
    if not counted:
        return declared.withColumn("rows", F.lit(0).cast("bigint"))
    return declared.join(reduce(DataFrame.unionByName, counted), "position", "left").select(
        "position", "source", "label", "status", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows")
    )


def build_corpus(
    spark: SparkSession,
    manifest: Manifest,
    readers: Mapping[str, Reader] | None = None,
    max_chars: int | None = MAX_CONTENT_CHARS,
    seed: int = SEED,
) -> DataFrame:
    """Sources, synthetic rows and label caps in one frame of corpus rows.

    The rows before capping are written once: choosing rows per label then
    reads labels and keys only, and the sources are not worked through again.
    """
    rows = union_sources(load_sources(spark, manifest, readers, max_chars, seed)).select("row_key", *CORPUS_COLUMNS)
    made = synthetic_corpus(spark, manifest.synthetic_counts, seed)
    if made is not None:
        rows = rows.unionByName(made.select(
            F.concat_ws(":", F.lit("synthetic"), "label", F.col("index").cast("string")).alias("row_key"),
            *CORPUS_COLUMNS,
        ))
    if not manifest.label_target_counts:
        return rows
    return rebalance(materialise(rows, "corpus"), manifest.label_target_counts, "row_key", seed=seed)


# --- labels: caps, shortfalls, ids ------------------------------------------------------------------


def target_table(spark: SparkSession, targets: Mapping[str, int], label: str = "label") -> DataFrame:
    return dimension(spark, [(k, int(v)) for k, v in targets.items()], f"{label} string, quota bigint")


def rebalance(
    df: DataFrame, targets: Mapping[str, int], id_col: str, label: str = "label", seed: int = SEED
) -> DataFrame:
    """Cap each label at its target: no target keeps all rows, a target of 0 or less drops the label."""
    if not targets:
        return df
    flagged = pick_by_hash(df, label, id_col, target_table(df.sparkSession, targets, label), "__keep", seed)
    return flagged.where(F.coalesce("__keep", F.lit(True))).drop("__keep")


def under_target(df: DataFrame, targets: Mapping[str, int], label: str = "label") -> DataFrame:
    """Labels present with fewer rows than their (positive) target."""
    counts = df.groupBy(label).agg(F.count("*").alias("count"))
    return counts.join(target_table(df.sparkSession, targets, label), label).where(
        "quota > 0 and count < quota"
    ).select(label, "count", F.col("quota").alias("target"))


def missing_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Categories that should have a source of their own but have no row."""
    wanted = [(c,) for c in CATEGORIES if c not in SELF_SUPPLIED_LABELS]
    return dimension(df.sparkSession, wanted, f"{label} string").join(
        df.select(label).distinct(), label, "left_anti"
    )


def label_ids(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, label_id): the distinct labels numbered from 0 in alphabetical order."""
    order = W.orderBy(label)
    return df.select(label).distinct().withColumn("label_id", (F.row_number().over(order) - 1).cast("bigint"))


def encode_labels(df: DataFrame, ids: DataFrame, label: str = "label") -> DataFrame:
    return df.join(checked_broadcast(ids), label, "left")


def decode_labels(df: DataFrame, ids: DataFrame, id_col: str, label: str = "label") -> DataFrame:
    """Label of an id; an unknown id is the default category."""
    names = ids.select(F.col("label_id").alias(id_col), F.col(label).alias("__name"))
    decoded = df.join(checked_broadcast(names), id_col, "left")
    return decoded.withColumn(label, F.coalesce("__name", F.lit(DEFAULT_CATEGORY))).drop("__name")


# --- order and splits -------------------------------------------------------------------------------


def shuffle_positions(df: DataFrame, id_col: str, seed: int = SEED) -> DataFrame:
    """Add each row's place in a seeded global shuffle, without sorting all rows in one range."""
    digest = hash_order(id_col, seed)
    keyed = df.withColumn("__h", digest)
    return dense_index(keyed, [], ["__h", id_col], hash_prefix(F.col("__h")), "position").drop("__h")


def shuffled(df: DataFrame, id_col: str, seed: int = SEED) -> DataFrame:
    """All rows in a seeded random order, range-partitioned by the digest."""
    return df.orderBy(hash_order(id_col, seed), id_col)


def stratified_split(
    df: DataFrame, label: str, id_col: str, test_size: float = 0.2, seed: int = SEED
) -> DataFrame:
    """Add ``split`` (train / validation). Validation holds ceil(test_size * rows), in label proportion."""
    counts = checked_broadcast(df.groupBy(label).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    held_out = math.ceil(test_size * total)
    quotas = proportional_quotas(counts, label, total - held_out).select(
        label, (F.col("n") - F.col("quota")).alias("quota")
    )
    flagged = pick_by_hash(df, label, id_col, quotas, "__held_out", seed)
    return flagged.withColumn("split", F.when(F.col("__held_out"), "validation").otherwise("train")).drop("__held_out")


def stratified_cap(
    df: DataFrame, label: str, id_col: str, max_rows: int, seed: int = SEED
) -> DataFrame:
    """At most ``max_rows`` rows in label proportion; 0 or a small enough table keeps all."""
    if max_rows <= 0:
        return df
    counts = checked_broadcast(df.groupBy(label).agg(F.count("*").alias("n")))
    total, classes = counts.agg(F.sum("n"), F.count("*")).first()
    if (total or 0) <= max_rows:
        return df
    if max_rows < classes:
        raise ValueError(f"A cap of {max_rows} rows cannot hold one row of each of {classes} labels.")
    quotas = proportional_quotas(counts, label, max_rows)
    return pick_by_hash(df, label, id_col, quotas, "__keep", seed).where("__keep").drop("__keep")
