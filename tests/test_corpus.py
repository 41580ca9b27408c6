from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sortflow.operators import corpus
from sortflow.operators.synthetic import counted_indexes, seed_corpus, synthetic_corpus
from sortflow.sources import tables
from sortflow.sources.files import read_files
from sortflow.sources.manifest import Manifest, SourceSpec

LONG = "a text that is long enough to stay"


def write_jsonl(path, rows):
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_source_rows_name_cut_and_dedup(spark):
    raw = spark.createDataFrame(
        [
            (0, "", "short"),
            (1, "", LONG),
            (2, "n.txt", LONG),
            (3, "n.txt", LONG + "  "),
            (4, None, LONG),
            (5, "x" * 300, LONG * 200),
        ],
        "id bigint, Name string, body string",
    )
    spec = SourceSpec(label="Logs", filename_columns=("name",), content_columns=("BODY",), id_column="id")
    got = rows_of(corpus.source_rows(raw, spec), "filename", "content")
    # Positions count the short row; made-up names keep equal rows apart; the named copies collapse.
    assert got == sorted(
        [("logs_sample_1.log", LONG), ("logs_sample_4.log", LONG), ("n.txt", LONG), ("x" * 180, (LONG * 200)[:4000])]
    )
    uncut = corpus.source_rows(raw, spec, max_chars=None)
    assert uncut.agg(F.max(F.length("content"))).first()[0] == len(LONG * 200)


def test_rows_without_an_id_are_ordered_by_content_digest(spark):
    raw = spark.createDataFrame([(LONG,), (LONG,), (LONG + "!",)], "body string")
    spec = SourceSpec(label="Docs", content_columns=("body",))
    got = rows_of(corpus.source_rows(raw, spec), "filename")
    assert got == [("docs_sample_0.txt",), ("docs_sample_1.txt",)]
    with pytest.raises(ValueError, match="id_column"):
        corpus.source_rows(raw, SourceSpec(label="Docs", content_columns=("body",), drop_duplicates=False))


def test_names_from_content_prefix(spark):
    raw = spark.createDataFrame([(1, LONG * 3)], "id bigint, body string")
    spec = SourceSpec(label="Docs", content_columns=("body",), filename_from_content_prefix=True, id_column="id")
    assert rows_of(corpus.source_rows(raw, spec), "filename") == [((LONG * 3)[:40].strip(),)]


def test_filters_compare_normalised_text(spark):
    df = spark.createDataFrame([(" EN ", 1, True), ("de", 0, False)], "lang string, n int, ok boolean")

    def hits(filters):
        return df.where(corpus.matches_filters(df, filters)).count()

    assert hits({"Lang": "en"}) == 1
    assert hits({"lang": "en", "n": 1, "ok": True}) == 1
    assert hits({"n": 0}) == 1
    assert hits({"absent": "x"}) == 0
    assert hits({}) == 2


def test_sample_limit_is_a_fixed_choice(spark):
    df = spark.range(100)
    first = rows_of(corpus.sample_rows(df, "id", 10), "id")
    assert len(first) == 10 and first == rows_of(corpus.sample_rows(df.repartition(7), "id", 10), "id")
    assert corpus.sample_rows(df, "id", 0).count() == 100
    assert corpus.sample_rows(df, "id", 500).count() == 100


def test_dedup_is_per_source_and_idempotent(spark):
    df = spark.createDataFrame(
        [(3, "s", "f", "c", "l"), (1, "s", "f", "c", "l"), (2, "t", "f", "c", "l")],
        "id bigint, source string, filename string, content string, label string",
    )
    once = corpus.dedup_keyed(df, ["source"], "id")
    assert rows_of(once, "source", "id") == [("s", 1), ("t", 2)]
    assert rows_of(corpus.dedup_keyed(once, ["source"], "id"), "source", "id") == [("s", 1), ("t", 2)]


def test_rebalance_caps_drops_and_keeps(spark):
    df = spark.range(90).select("id", F.element_at(F.array(*map(F.lit, ["A", "B", "C"])), (F.col("id") % 3 + 1).cast("int")).alias("label"))
    sizes = {r.label: r["count"] for r in corpus.rebalance(df, {"A": 7, "B": 0}, "id").groupBy("label").count().collect()}
    assert sizes == {"A": 7, "C": 30}
    assert corpus.rebalance(df, {}, "id").count() == 90
    assert rows_of(corpus.under_target(df, {"A": 40, "B": 0, "C": 30}), "label", "count", "target") == [("A", 30, 40)]


def test_manifest_run_end_to_end(spark, tmp_path):
    docs = write_jsonl(tmp_path / "docs.jsonl", [{"filename": f"d{i}.txt", "content": f"{LONG} {i}"} for i in range(8)])
    manifest = Manifest.from_dict(
        {
            "sources": [
                {"path": docs, "label": "Docs", "filename_columns": ["filename"], "content_columns": ["content"]},
                {"path": str(tmp_path / "none.csv"), "label": "Study", "content_columns": ["x"]},
                {"path": docs, "label": "Nonsense", "content_columns": ["content"]},
                {"path": docs, "label": "Finance", "content_columns": []},
                {"kind": "huggingface", "dataset": "hub/set", "label": "Code", "content_columns": ["x"]},
            ],
            "label_target_counts": {"Docs": 5, "Media": 3},
            "synthetic_counts": {"Media": 4, "Logs": 2, "Nope": 9, "Other": 0},
        }
    )
    built = corpus.build_corpus(spark, manifest)
    sizes = {r.label: r["count"] for r in built.groupBy("label").count().collect()}
    assert sizes == {"Docs": 5, "Media": 3, "Logs": 2}
    audit = corpus.source_audit(spark, corpus.load_sources(spark, manifest))
    assert [r[1:] for r in rows_of(audit, "position", "status", "rows")] == [
        ("loaded", 8), ("skipped", 0), ("skipped", 0), ("skipped", 0), ("skipped", 0),
    ]
    with pytest.raises(RuntimeError, match="Required source failed"):
        corpus.load_sources(spark, Manifest.from_dict({"sources": [{"path": "/none.csv", "label": "Docs", "content_columns": ["x"], "required": True}]}))
    with pytest.raises(ValueError, match="list of sources"):
        Manifest.from_dict({})


def test_one_table_may_serve_two_entries(spark, tmp_path):
    path = write_jsonl(tmp_path / "t.jsonl", [{"id": i, "content": f"{LONG} {i}"} for i in range(6)])
    entry = {"path": path, "label": "Docs", "content_columns": ["content"], "id_column": "id"}
    manifest = Manifest.from_dict({"sources": [entry, entry, {**entry, "label": "Study"}], "label_target_counts": {"Docs": 7}})
    built = corpus.build_corpus(spark, manifest)
    assert {r.label: r["count"] for r in built.groupBy("label").count().collect()} == {"Docs": 7, "Study": 6}
    assert built.select("row_key").distinct().count() == 13


def test_hub_sources_take_a_reader(spark):
    spec = {"kind": "huggingface", "dataset": "hub/set", "label": "Code", "content_columns": ["text"], "filters": {"lang": "py"}}
    frame = spark.createDataFrame([(LONG, "py"), (LONG + "2", "js")], "text string, lang string")
    loads = corpus.load_sources(spark, Manifest.from_dict({"sources": [spec]}), {"huggingface": lambda _s, _spec: frame})
    assert rows_of(corpus.union_sources(loads), "source", "content") == [("hub/set", LONG)]


def test_formats_read_the_same(spark, tmp_path):
    rows = [{"filename": "a.txt", "content": 'line "one"\nline, two', "label": "Docs"}, {"filename": "б.txt", "content": "", "label": "Media"}]
    (tmp_path / "t.json").write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    write_jsonl(tmp_path / "t.ndjson", rows)
    frame = spark.createDataFrame(rows, "filename string, content string, label string")
    for fmt in ("csv", "parquet", "jsonl"):
        counts = tables.write_corpus(frame, str(tmp_path / f"t.{fmt}"), fmt)
        assert rows_of(counts, "label", "count") == [("Docs", 1), ("Media", 1)]
    expected = sorted((r["filename"], r["content"], r["label"]) for r in rows)
    for name in ("t.json", "t.ndjson", "t.csv", "t.parquet", "t.jsonl"):
        assert rows_of(tables.load_corpus(spark, str(tmp_path / name)), "filename", "content", "label") == expected
    assert "б.txt" in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "t.jsonl").glob("part-*"))
    with pytest.raises(ValueError, match="no reader"):
        tables.load_table(spark, "x.xml")
    with pytest.raises(ValueError, match=r"absent: \['content', 'label'\]"):
        tables.check_corpus(frame.select("filename"))


def test_text_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("héllo\r\nwörld  ".encode() + b"\xff\xfe tail")
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8binary")
    (tmp_path / ".env").write_text("secret")
    (tmp_path / "c.py").write_text("x" * 600)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.txt").write_text("below")
    got = dict(rows_of(read_files(spark, str(tmp_path)), "filename", "content"))
    assert got == {"a.TXT": "héllo\nwörld   tail", "b.jpg": "", "c.py": "x" * 500}


def test_labels_encode_and_decode(spark):
    df = spark.createDataFrame([("Study",), ("Code",), ("Docs",)], "label string")
    ids = corpus.label_ids(df)
    assert rows_of(ids, "label", "label_id") == [("Code", 0), ("Docs", 1), ("Study", 2)]
    codes = spark.createDataFrame([(2,), (9,)], "code bigint")
    assert rows_of(corpus.decode_labels(codes, ids, "code"), "code", "label") == [(2, "Study"), (9, "Other")]


def test_missing_labels(spark):
    df = spark.createDataFrame([("Code",), ("Media",)], "label string")
    assert rows_of(corpus.missing_labels(df), "label") == [("Docs",), ("Finance",), ("Logs",), ("Study",)]


def test_made_up_rows(spark):
    made = synthetic_corpus(spark, {"Finance": 50, "Media": 5, "Code": 0, "Unknown": 3})
    rows = made.collect()
    assert {r.label for r in rows} == {"Finance", "Media"} and len(rows) == 55
    assert all(r.content == "" for r in rows if r.label == "Media")
    assert all("{" not in r.content for r in rows if r.label == "Finance")
    assert rows_of(counted_indexes(spark, {"a": 2, "b": 1}), "label", "index") == [("a", 0), ("a", 1), ("b", 0)]
    assert synthetic_corpus(spark, {}) is None


def test_seed_corpus(spark):
    seeds = {(r.label, r["index"]): r for r in seed_corpus(spark).collect()}
    assert len(seeds) == 540
    row = seeds[("Finance", 3)]
    assert row.filename == "платежное_поручение_3.txt"
    assert row.content.startswith("Платежное поручение №1003 от 08.04.2026. Контрагент: ИП Соколова.")
    assert f"Сумма к оплате {15000 + 3 * 137} руб., НДС {round((15000 + 3 * 137) * 0.2, 2)} руб." in row.content
    for i in range(180):
        assert f"НДС {round((15000 + i * 137) * 0.2, 2)} руб." in seeds[("Finance", i)].content


def test_shuffle_is_a_permutation(spark):
    placed = corpus.shuffle_positions(spark.range(300), "id").collect()
    assert sorted(r.position for r in placed) == list(range(300))
    order = [r.id for r in corpus.shuffled(spark.range(300), "id").collect()]
    assert order == [r.id for r in sorted(placed, key=lambda r: r.position)]
