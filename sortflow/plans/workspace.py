"""Scratch folders for tables and stream checkpoints, on storage every executor can reach."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_roots: dict[str, str] = {}
_scopes = threading.local()


def shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only for a local master without the setting."""
    root = spark.conf.get(SETTING, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"Set {SETTING} to a folder shared by all executors.")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="sortflow-")
    return _local_roots[app]


def _session_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/sortflow/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A folder name not used before, below one folder per application."""
    return f"{_session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def folder_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder, none if there is no such folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(found.getPath().getName() for found in system.listStatus(path)) if system.exists(path) else []


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to scratch. Results read from there must be stored by then."""
    delete_folder(spark, _session_folder(spark))


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that this thread materialises inside, at the end. Their readers must be done by then."""
    outer = getattr(_scopes, "created", None)
    _scopes.created = created = []
    try:
        yield
    finally:
        _scopes.created = outer
        for folder in created:
            delete_folder(spark, folder)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries made and run inside delete their shuffle files as they end, not when the driver happens to collect its garbage."""
    outer = spark.conf.get(SHUFFLES)
    spark.conf.set(SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES, outer)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the written table, so that a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    created = getattr(_scopes, "created", None)
    if created is not None:
        created.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
