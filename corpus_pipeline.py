"""A training corpus from raw documents: known languages, one of each near copy, no benchmarks, no personal data, packed.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns a DataFrame; ``run`` writes it as Parquet and reads it again as the next
stage's docs. All stages but the last return the columns of ``documents``.

Defined results: a null, empty or letterless text is no known language and goes in
the first stage; an empty table gives an empty result; of repeated rows, and of all
rows linked with one another, the near-copy stage keeps one row, of the smallest id; rows without an id
come after all ids; one id with two unlike texts keeps both; extra columns are
carried through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sortflow.llm.decontamination import decontaminate
from sortflow.llm.jaccard_join import keep_one_of_each
from sortflow.llm.language_id import keep_known_languages, train_languages
from sortflow.llm.packing import pack_documents
from sortflow.llm.pii import sanitise
from sortflow.llm.queries import held_out, tokenizer_path
from sortflow.plans.workspace import materialise


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and texts in none of the corpus's languages."""
    return keep_known_languages(docs, train_languages(docs.where(~held_out())))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of every group of texts linked by 80 % of their five-word shingles."""
    return keep_one_of_each(docs, width=5, percent=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten consecutive words of a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents")


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data, and the terms that give it away, in the text."""
    return sanitise(docs, length_col="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all texts into windows of 512 to 4096 tokens."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("language", language_stage),
    ("near_copies", near_copy_stage),
    ("benchmark", benchmark_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: Trained code lengths and token ids are beyond SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
