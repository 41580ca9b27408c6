from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_chunks(monkeypatch):
    """Chunks of a few rows, so that every scan crosses chunk borders."""
    from sortflow.operators import destinations, evaluate, movelog
    from sortflow.plans import scan

    def tiny(id_col: str, rows: int = 3):
        return scan.F.expr(f"`{id_col}` div {rows}")

    for module in (scan, destinations, evaluate, movelog):
        monkeypatch.setattr(module, "id_chunk", tiny)
    monkeypatch.setattr(destinations, "CHUNK_ROWS", 3)
