from __future__ import annotations

import os

import pytest

from sortflow.plans import workspace


def test_tables_live_in_the_shared_folder_until_dropped(spark):
    df = workspace.materialise(spark.range(5), "numbers")
    root = workspace.shared_root(spark)
    assert root == spark.conf.get("spark.checkpoint.dir")
    (file,) = {os.path.dirname(f) for f in df.inputFiles()}
    assert file.startswith(f"file://{root}/sortflow/") and df.count() == 5
    workspace.drop_scratch(spark)
    assert not os.path.exists(f"{root}/sortflow/{spark.sparkContext.applicationId}")


def test_a_scope_deletes_only_its_own_tables(spark):
    kept = workspace.materialise(spark.range(2), "kept")
    with workspace.scratch_scope(spark):
        inner = workspace.materialise(spark.range(3), "inner")
        (folder,) = {os.path.dirname(f).removeprefix("file://") for f in inner.inputFiles()}
        assert inner.count() == 3 and os.path.exists(folder)
    assert not os.path.exists(folder) and kept.count() == 2


def test_a_cluster_must_name_the_folder(monkeypatch):
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workspace.shared_root(Session())
