from __future__ import annotations

import re

from sortflow.workload.corpus_queries import read_formats


def test_contents_are_not_shuffled_whole(spark, tmp_path, capsys):
    texts = ["one", "one", "two", "", None]
    rows = spark.createDataFrame([(i, t, "en", "src") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    found = read_formats(spark, str(tmp_path))
    found.explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(label" in plan and not re.search(r"hashpartitioning\(label#\d+, content#", plan)
    got = {tuple(r) for r in found.select("format", "label", "rows", "chars", "contents").collect()}
    assert got == {(f, "Docs", 5, 9, 3) for f in ("csv", "json", "jsonl", "ndjson", "parquet")}
