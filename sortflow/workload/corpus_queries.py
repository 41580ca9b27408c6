"""Corpus building over whole tables. Texts are not cut: the bound on content is a parameter, off here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sortflow.functions.templates import (
    SEED_CHOICES,
    SEED_TEMPLATES,
    SYNTHETIC_CHOICES,
    SYNTHETIC_RANGES,
    SYNTHETIC_TEMPLATES,
)
from sortflow.functions.text import normalize_text
from sortflow.functions.vocabulary import CATEGORIES
from sortflow.operators import corpus as ops
from sortflow.operators.synthetic import seed_rows, synthetic_rows
from sortflow.plans.once import computed_once
from sortflow.plans.workspace import materialise, scratch
from sortflow.sources.manifest import Manifest
from sortflow.sources.tables import CORPUS_COLUMNS, check_corpus, label_counts, load_table, write_corpus, write_json_arrays
from sortflow.workload import sqltext as q
from sortflow.workload.registry import query, table
from sortflow.workload.views import view, with_views

TARGETS = {"Docs": 200, "Finance": 100, "Study": 500, "Logs": 0}
_TARGET_SQL = "targets(label, quota) as (values ('Docs', 200), ('Finance', 100), ('Study', 500), ('Logs', 0))"


def manifest(sf: str) -> Manifest:
    """Four sources of different shape, and one that is not there."""
    return Manifest.from_dict(
        {
            "sources": [
                {
                    "dataset": "documents", "path": f"{sf}/documents.parquet", "label": "Docs",
                    "content_columns": ["text"], "filename_from_content_prefix": True,
                    "min_content_length": 40, "id_column": "doc_id",
                },
                {
                    "dataset": "pages", "path": f"{sf}/pages.parquet", "label": "Study",
                    "filename_columns": ["title", "URL"], "content_columns": ["url", "html"],
                    "id_column": "page_id",
                },
                {
                    "dataset": "conversations", "path": f"{sf}/conversations.parquet", "label": "Logs",
                    "filename_columns": ["role"], "content_columns": ["text"], "min_content_length": 30,
                    "filters": {"Role": "ASSISTANT"},
                },
                {
                    "dataset": "benchmark", "path": f"{sf}/benchmark.parquet", "label": "Finance",
                    "filename_columns": ["title"], "content_columns": ["text"], "id_column": "item_id",
                },
                {
                    "dataset": "absent", "path": f"{sf}/absent.parquet", "label": "Code",
                    "content_columns": ["text"],
                },
            ]
        }
    )


_UNION_SQL = f"""union_rows as (
  select distinct 'documents' as source, {q.strip(f"substr({q.norm('text')}, 1, 40)")} as filename, {q.norm('text')} as content,
      'Docs' as label
    from documents where length({q.norm('text')}) >= 40
  union all
  select distinct 'pages', substr({q.norm('url')}, 1, 180), {q.norm('url')} || ' ' || {q.norm('html')}, 'Study'
    from pages where length({q.norm('url')} || ' ' || {q.norm('html')}) >= 20
  union all
  select distinct 'conversations', {q.norm('role')}, {q.norm('text')}, 'Logs' from conversations
    where lower({q.norm('role')}) = 'assistant' and length({q.norm('text')}) >= 30
  union all
  select 'benchmark', 'finance_sample_' || (row_number() over (order by item_id) - 1) || '.txt', {q.norm('text')},
      'Finance'
    from benchmark qualify length({q.norm('text')}) >= 20)"""


@query("corpus_union", f"with {_UNION_SQL} select * from union_rows")
def corpus_union(spark: SparkSession, sf: str) -> DataFrame:
    return ops.union_sources(ops.load_sources(spark, manifest(sf), max_chars=None)).drop("row_key")


@query(
    "source_audit",
    f"""with {_UNION_SQL}, declared(position, source, label, status) as (values
          (0, 'documents', 'Docs', 'loaded'), (1, 'pages', 'Study', 'loaded'), (2, 'conversations', 'Logs', 'loaded'),
          (3, 'benchmark', 'Finance', 'loaded'), (4, 'absent', 'Code', 'skipped'))
        select d.position, d.source, d.label, d.status, count(u.source) as rows
        from declared d left join union_rows u on u.source = d.source group by all""",
)
def source_audit(spark: SparkSession, sf: str) -> DataFrame:
    return ops.source_audit(spark, ops.load_sources(spark, manifest(sf), max_chars=None))


@query(
    "read_formats",
    f"""{with_views('corpus')}, formats(format) as (values ('csv'), ('json'), ('jsonl'), ('ndjson'), ('parquet'))
        select format, label, count(*) as rows, sum(length(content))::bigint as chars, count(distinct content) as contents
        from corpus, formats group by format, label""",
)
def read_formats(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus written in each format and read back; ``json`` are files of one array for 1,000 ids each."""
    corpus = view(spark, sf, "corpus").select("doc_id", *CORPUS_COLUMNS)
    schema = T.StructType([T.StructField(name, T.StringType()) for name in CORPUS_COLUMNS])
    folder, read = scratch(spark, "formats"), []
    write_json_arrays(corpus.withColumn("chunk", F.floor(F.col("doc_id") / 1_000)), f"{folder}/corpus.json", "chunk")
    for fmt in ("csv", "jsonl", "ndjson", "parquet"):
        write_corpus(corpus, f"{folder}/corpus.{fmt}", fmt)
    for fmt in ("csv", "json", "jsonl", "ndjson", "parquet"):
        back = check_corpus(load_table(spark, f"{folder}/corpus.{fmt}", schema=schema))
        read.append(
            back.groupBy("label")
            .agg(
                F.count("*").alias("rows"),
                F.sum(F.char_length("content")).alias("chars"),
                # Digests stand for the contents, which would be shuffled whole.
                F.countDistinct(F.unhex(F.sha2("content", 256))).alias("contents"),
            )
            .withColumn("format", F.lit(fmt))
        )
    return reduce(DataFrame.unionByName, read)


@query(
    "corpus_load",
    f"""{with_views('corpus')} select doc_id, coalesce(nullif(filename, ''), '') as filename,
          coalesce(content, '') as content, label from corpus""",
)
def corpus_load(spark: SparkSession, sf: str) -> DataFrame:
    with_nulls = view(spark, sf, "corpus").withColumn("filename", F.nullif(F.col("filename"), F.lit("")))
    return check_corpus(with_nulls).select("doc_id", *CORPUS_COLUMNS)


@query(
    "label_counts",
    f"""{with_views('corpus')}, {_TARGET_SQL}, kept as (
          select label, count(*) as n from (
            select distinct source, filename, {q.norm('content')} as content, label from corpus
            where length({q.norm('content')}) >= 20) group by label)
        select k.label, least(k.n, coalesce(t.quota, k.n)) as count
        from kept k left join targets t on k.label = t.label where coalesce(t.quota, 1) > 0""",
)
def corpus_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus from raw rows to balanced labels, counted."""
    return label_counts(built_corpus(spark, sf))


def built_corpus(spark: SparkSession, sf: str) -> DataFrame:
    rows = computed_once(
        view(spark, sf, "corpus"),
        ["doc_id", "source", "filename", "label"],
        {"content": normalize_text(F.col("content"))},
    )
    unique = ops.dedup_keyed(ops.min_content(rows, 20), ["source"], "doc_id")
    return ops.rebalance(materialise(unique, "corpus"), TARGETS, "doc_id")


@query("dedup_full_row", "select distinct lang, source, text from documents")
def dedup_full_row(spark: SparkSession, sf: str) -> DataFrame:
    return ops.drop_full_row_duplicates(table(spark, sf, "documents").select("lang", "source", "text"))


@query(
    "dedup_keyed",
    f"""select * from (
          select lang as source, lang || '.txt' as filename, 'Docs' as label, length({q.norm('text')}) as n_chars,
            doc_id from documents
          qualify row_number() over (partition by lang, {q.norm('text')} order by doc_id) = 1)""",
)
def dedup_keyed(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(
        "doc_id",
        F.col("lang").alias("source"),
        F.concat("lang", F.lit(".txt")).alias("filename"),
        normalize_text(F.col("text")).alias("content"),
        F.lit("Docs").alias("label"),
    )
    return ops.dedup_keyed(rows, ["source"], "doc_id").select(
        "source", "filename", "label", F.char_length("content").cast("bigint").alias("n_chars"), "doc_id"
    )


@query(
    "source_sample",
    f"select doc_id, source from documents qualify {q.hash_rank('source', 'doc_id')} <= 20",
)
def source_sample(spark: SparkSession, sf: str) -> DataFrame:
    return ops.sample_per_source(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 20)


@query(
    "rebalance",
    f"""{with_views('corpus')}, {_TARGET_SQL}
        select c.doc_id, c.label from (
          select doc_id, label, {q.hash_rank('label', 'doc_id')} as place from corpus) c
        left join targets t on c.label = t.label where t.quota is null or c.place <= t.quota""",
)
def rebalance(spark: SparkSession, sf: str) -> DataFrame:
    return ops.rebalance(view(spark, sf, "corpus").select("doc_id", "label"), TARGETS, "doc_id")


@query(
    "under_target",
    f"""{with_views('corpus')}, {_TARGET_SQL}
        select label, count(*) as count, quota::bigint as target from corpus join targets using (label)
        where quota > 0 group by label, quota having count(*) < quota""",
)
def under_target(spark: SparkSession, sf: str) -> DataFrame:
    return ops.under_target(view(spark, sf, "corpus").select("label"), TARGETS).select(
        "label", "count", F.col("target").cast("bigint").alias("target")
    )


@query(
    "missing_labels",
    f"""{with_views('corpus')} select label from (values ('Code'), ('Docs'), ('Finance'), ('Study'), ('Logs')) t(label)
        where label not in (select label from corpus)""",
)
def missing_labels(spark: SparkSession, sf: str) -> DataFrame:
    return ops.missing_labels(view(spark, sf, "corpus"))


@query("shuffle_order", f"select doc_id, {q.hash_rank('', 'doc_id')} - 1 as position from documents")
def shuffle_order(spark: SparkSession, sf: str) -> DataFrame:
    return ops.shuffle_positions(table(spark, sf, "documents").select("doc_id"), "doc_id")


def _quota_sql(draws: str) -> str:
    """Largest remainder, in exact integers."""
    return f"""counts as (select lang, count(*) as n from documents group by lang),
      shares as (select lang, n, {draws} as draws, (select sum(n) from counts) as total from counts),
      parts as (select *, (n::hugeint * draws::hugeint) // total::hugeint as base,
                  (n::hugeint * draws::hugeint) % total::hugeint as rest from shares),
      quotas as (select lang, n, base + case when row_number() over (order by rest desc, lang)
                  <= draws - sum(base) over () then 1 else 0 end as quota from parts)"""


@query(
    "stratified_split",
    f"""with {_quota_sql('(select sum(n) - ceil(0.2 * sum(n)) from counts)')}
        select d.doc_id, d.lang, case when d.place <= q.n - q.quota then 'validation' else 'train' end as split
        from (select doc_id, lang, {q.hash_rank('lang', 'doc_id')} as place from documents) d
        join quotas q on d.lang = q.lang""",
)
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return ops.stratified_split(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query(
    "stratified_cap",
    f"""with {_quota_sql('least(500, (select sum(n) from counts))')}
        select d.doc_id, d.lang from (select doc_id, lang, {q.hash_rank('lang', 'doc_id')} as place from documents) d
        join quotas q on d.lang = q.lang where d.place <= q.quota""",
)
def stratified_cap(spark: SparkSession, sf: str) -> DataFrame:
    return ops.stratified_cap(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 500)


# --- made-up rows, one per row of a table -----------------------------------------------------------


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _filled(template: str, values: dict[str, str]) -> str:
    sql = _quoted(template)
    for name, value in values.items():
        sql = sql.replace("{" + name + "}", f"' || ({value}) || '")
    return f"({sql})"


def _choice(label: str, slot: str, index: str, size: int) -> str:
    return f"(('0x' || substr(md5('42:{label}:{slot}:' || {index}), 1, 8))::bigint % {size})"


def _item(items: list[str], position: str) -> str:
    return f"([{', '.join(_quoted(x) for x in items)}])[{position} + 1]"


def _cents(c: str) -> str:
    return (
        f"(({c}) // 100) || '.' || (case when ({c}) % 10 = 0 then (({c}) % 100 // 10)::varchar "
        f"else lpad((({c}) % 100)::varchar, 2, '0') end)"
    )


def _synthetic_sql(position: int) -> str:
    cases = []
    for label, templates in SYNTHETIC_TEMPLATES.items():
        values = {"index": "i", "index4": "lpad(i::varchar, greatest(4, length(i::varchar))::int, '0')"}
        values["index5"] = "lpad(i::varchar, greatest(5, length(i::varchar))::int, '0')"
        for slot, items in SYNTHETIC_CHOICES.get(label, {}).items():
            values[slot] = _item(items, _choice(label, slot, "i", len(items)))
        for slot, (low, high) in SYNTHETIC_RANGES.get(label, {}).items():
            values[slot] = f"({low} + {_choice(label, slot, 'i', high - low + 1)})"
        if label == "Finance":
            amount = values["amount"]
            values |= {
                "subtotal": f"{amount} - 120",
                "tax": _cents(f"{amount} * 13"),
                "net": _cents(f"{amount} * 100 - {amount} * 13 + 500000"),
                "half": f"{amount} // 2",
            }
        if label == "Logs":
            values["day2"] = f"lpad(({values['day']})::varchar, 2, '0')"
        for option, template in enumerate(templates):
            here = f"label = '{label}' and {_choice(label, 'template', 'i', len(templates))} = {option}"
            cases.append(f"when {here} then {_filled(template[position], values)}")
    return f"case {' '.join(cases)} end"


_LABEL_LIST = ", ".join(f"'{c}'" for c in [*CATEGORIES, "Unknown"])


@query(
    "synthetic_rows",
    f"""with wanted as (select ([{_LABEL_LIST}])[doc_id % 9 + 1] as label, doc_id as i from documents)
        select label, i as index, {_synthetic_sql(0)} as filename, {_synthetic_sql(1)} as content
        from wanted where label <> 'Unknown'""",
)
def synthetic_rows_query(spark: SparkSession, sf: str) -> DataFrame:
    """One made-up row per document, the labels taken in turn."""
    names = F.array(*[F.lit(c) for c in [*CATEGORIES, "Unknown"]])
    wanted = table(spark, sf, "documents").select(
        F.get(names, (F.col("doc_id") % 9).cast("int")).alias("label"), F.col("doc_id").alias("index")
    )
    return synthetic_rows(wanted, "label", "index")


def _seed_sql(position: int) -> str:
    cases = []
    for label, template in SEED_TEMPLATES.items():
        values = {"index": "i"}
        for slot, items in SEED_CHOICES[label].items():
            values[slot] = _item(items, f"i % {len(items)}")
        if label == "Finance":
            words = f"replace({values['name']}, '_', ' ')"
            values |= {
                "title": f"upper(substr({words}, 1, 1)) || lower(substr({words}, 2))",
                "number": "1000 + i",
                "amount": "15000 + i * 137",
                "vat": _cents("(15000 + i * 137) * 20"),
            }
        cases.append(f"when label = '{label}' then {_filled(template[position], values)}")
    return f"case {' '.join(cases)} end"


@query(
    "seed_corpus",
    f"""with wanted as (
          select (['Docs', 'Finance', 'Study'])[p_partkey % 3 + 1] as label, p_partkey as i from part)
        select label, i as index, {_seed_sql(0)} as filename, {_seed_sql(1)} as content from wanted""",
)
def seed_corpus_query(spark: SparkSession, sf: str) -> DataFrame:
    """One seed row per part, the labels taken in turn."""
    names = F.array(*[F.lit(c) for c in SEED_TEMPLATES])
    wanted = table(spark, sf, "part").select(
        F.get(names, (F.col("p_partkey") % 3).cast("int")).alias("label"), F.col("p_partkey").alias("index")
    )
    return seed_rows(wanted, "label", "index")
