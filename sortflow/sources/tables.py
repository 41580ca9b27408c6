"""Reading and writing labelled tables in the supported formats."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS_COLUMNS = ["filename", "content", "label"]


def table_format(path: str, file_format: str | None = None) -> str:
    fmt = (file_format or PurePosixPath(path).suffix.lstrip(".")).lower()
    if fmt not in {"csv", "jsonl", "ndjson", "json", "parquet"}:
        raise ValueError(f"Cannot read {path}: no reader for {fmt!r}")
    return fmt


def _read_csv(reader: DataFrameReader, path: str, infer: bool) -> DataFrame:
    return reader.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=infer)


def load_table(
    spark: SparkSession,
    path: str,
    file_format: str | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Read csv, jsonl / ndjson, json or parquet; the format comes from the argument, else from the suffix.

    Give a ``schema`` for large csv and json sources: inferring one reads the
    data twice. ``json`` is one document per file and csv fields may span
    lines, so such files are split between tasks by file, not inside a file.
    """
    fmt = table_format(path, file_format)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        return _read_csv(reader, path, infer=schema is None)
    if fmt == "json":
        return reader.json(path, multiLine=True)
    if fmt in {"jsonl", "ndjson"}:
        return reader.json(path)
    return reader.parquet(path)


def fill_nulls(df: DataFrame) -> DataFrame:
    """Null text becomes empty text."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.fillna("", subset=texts) if texts else df


def check_corpus(df: DataFrame) -> DataFrame:
    """The corpus contract: three text columns, no nulls; further columns are kept."""
    missing = sorted(set(CORPUS_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"Not a corpus, these columns are absent: {missing}")
    for name in CORPUS_COLUMNS:
        df = df.withColumn(name, F.coalesce(F.col(name).cast("string"), F.lit("")))
    return df


def load_corpus(spark: SparkSession, path: str, file_format: str | None = None) -> DataFrame:
    """A corpus in any format. Cells of csv stay the text they are: names like 001 are no numbers."""
    if table_format(path, file_format) == "csv":
        return check_corpus(_read_csv(spark.read, path, infer=False))
    return check_corpus(load_table(spark, path, file_format))


def write_corpus(df: DataFrame, path: str, file_format: str = "parquet") -> DataFrame:
    """Write the corpus and return its per-label counts, read back from what was written."""
    fmt = table_format(path, file_format)
    if fmt == "json":
        raise ValueError("Write jsonl; Spark writes one document per line.")
    writer = df.select(*CORPUS_COLUMNS).write.mode("overwrite")
    if fmt == "csv":
        writer.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        writer.json(path)
    schema = T.StructType([T.StructField(name, T.StringType()) for name in CORPUS_COLUMNS])
    return label_counts(load_table(df.sparkSession, path, fmt, schema))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One UTF-8 JSON object per line, non-ASCII text unescaped."""
    df.write.mode("overwrite").json(path)


def write_json_arrays(df: DataFrame, path: str, group: str) -> None:
    """Files of one JSON array each, of the rows with an equal ``group``. A group is one document, so keep groups small."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != group])
    arrays = df.groupBy(group).agg(F.to_json(F.collect_list(row)).alias("value"))
    arrays.write.mode("overwrite").partitionBy(group).text(path)


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count("*").alias("count")).orderBy("label")
