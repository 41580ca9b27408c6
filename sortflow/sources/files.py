"""Folders of plain files as DataFrames of (filepath, filename, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sortflow.functions.paths import base_name, extension, visible_name
from sortflow.functions.text import extracted_text
from sortflow.functions.vocabulary import EXTRACT_CHARS, TEXT_SUFFIXES
from sortflow.sources import heads

BINARY_FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def decode_text(content: Column) -> Column:
    """UTF-8 text with undecodable bytes dropped and line ends unified. A literal U+FFFD is dropped as well."""
    text = F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))
    return F.regexp_replace(text, r"\r\n?", "\n")


def has_text_suffix(name: Column) -> Column:
    return F.lower(extension(name)).isin(TEXT_SUFFIXES)


def file_text(name: Column, content: Column, max_chars: int = EXTRACT_CHARS) -> Column:
    """Bounded text of a file, empty unless the suffix is a text one."""
    return F.when(has_text_suffix(name), extracted_text(decode_text(content), max_chars)).otherwise("")


def read_files(spark: SparkSession, folder: str, max_chars: int = EXTRACT_CHARS, recursive: bool = False) -> DataFrame:
    """All visible files of a folder. Of files with a text suffix the head is read, of the rest only the names are listed."""
    heads.register(spark)
    reader = spark.read.format(heads.FORMAT).option("max_chars", max_chars).option("recursive", recursive)
    found = reader.option("suffixes", ",".join(TEXT_SUFFIXES)).load(folder)
    name = base_name(F.col("path"))
    return found.where(visible_name(name)).select(
        F.col("path").alias("filepath"),
        name.alias("filename"),
        F.when(has_text_suffix(name), extracted_text(F.col("head"), max_chars)).otherwise("").alias("content"),
    )
