"""Text and file-name expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortflow.functions.labels import category_icon, confidence_band
from sortflow.functions.paths import (
    ensure_filename,
    featurize_name,
    model_text_input,
    path_suffixes,
    visible_name,
)
from sortflow.functions.text import (
    collect_present,
    error_preview,
    extracted_text,
    first_present,
    normalize_text,
    normalize_value,
    result_preview,
)
from sortflow.functions.vocabulary import CATEGORIES, MAX_CONTENT_CHARS, NAME_PREFIX_CHARS
from sortflow.operators.corpus import decode_labels, encode_labels, label_ids, matches_filters, min_content
from sortflow.plans.scan import dense_index, id_chunk
from sortflow.plans.workspace import scratch
from sortflow.sources.files import read_files
from sortflow.workload import sqltext as q
from sortflow.workload.registry import query, table
from sortflow.workload.views import view, with_views


@query("text_preview", f"select doc_id, {q.strip('substr(text, 1, 500)')} as preview from documents")
def text_preview(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", extracted_text(F.col("text")).alias("preview"))


@query("folder_preview", f"select item_id, {q.strip('substr(text, 1, 500)')} as preview from benchmark")
def folder_preview(spark: SparkSession, sf: str) -> DataFrame:
    """One text file per benchmark item, and the heads of these files."""
    folder = scratch(spark, "benchmark-files")
    table(spark, sf, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(folder)
    found = read_files(spark, folder, recursive=True).where("filename like 'part-%'")
    item = F.regexp_extract("filepath", r"/item_id=(\d+)/", 1).cast("bigint")
    return found.select(item.alias("item_id"), F.col("content").alias("preview"))


@query("normalize_text", f"select doc_id, {q.norm('text')} as content from documents")
def normalize_text_query(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", normalize_text(F.col("text")).alias("content"))


@query(
    "flatten_list_text",
    f"""select conv_id, turn, array_to_string(
          list_filter(list_transform([text, '', role], lambda x: {q.norm('x')}), lambda x: x <> ''), ' ') as flat
        from conversations""",
)
def flatten_list_text(spark: SparkSession, sf: str) -> DataFrame:
    cells = table(spark, sf, "conversations").withColumn("cells", F.array("text", F.lit(""), "role"))
    flat = normalize_value(F.col("cells"), cells.schema["cells"].dataType)
    return cells.select("conv_id", "turn", flat.alias("flat"))


@query(
    "first_present",
    f"""{with_views('raw_pages')} select page_id,
          coalesce(nullif({q.norm('title')}, ''), nullif({q.norm('url')}, ''), '') as name from raw_pages""",
)
def first_present_query(spark: SparkSession, sf: str) -> DataFrame:
    pages = view(spark, sf, "raw_pages")
    return pages.select("page_id", first_present(pages, ["absent", "TITLE", "url"]).alias("name"))


@query(
    "collect_present",
    f"""{with_views('raw_pages')} select page_id,
          concat_ws(' ', nullif({q.norm('title')}, ''), nullif({q.norm('html')}, '')) as content from raw_pages""",
)
def collect_present_query(spark: SparkSession, sf: str) -> DataFrame:
    pages = view(spark, sf, "raw_pages")
    return pages.select("page_id", collect_present(pages, ["title", "HTML", "missing_column"]).alias("content"))


@query(
    "name_from_prefix",
    f"""{with_views('corpus')} select doc_id,
          case when {q.norm('filename')} = '' then substr({q.norm('content')}, 1, 40) else {q.norm('filename')} end
            as name from corpus""",
)
def name_from_prefix(spark: SparkSession, sf: str) -> DataFrame:
    corpus = view(spark, sf, "corpus")
    name = first_present(corpus, ["filename"])
    prefix = F.substring(first_present(corpus, ["content"]), 1, NAME_PREFIX_CHARS)
    return corpus.select("doc_id", F.when(name == "", prefix).otherwise(name).alias("name"))


@query(
    "ensure_filename",
    f"""{with_views('corpus')}, numbered as (
          select *, row_number() over (partition by source order by doc_id) - 1 as row_index from corpus)
        select doc_id, source, row_index,
          case when {q.strip('filename')} <> '' then substr({q.strip('filename')}, 1, 180)
               else lower(label) || '_sample_' || row_index || (case label when 'Logs' then '.log' else '.txt' end)
          end as filename from numbered""",
)
def ensure_filename_query(spark: SparkSession, sf: str) -> DataFrame:
    corpus = view(spark, sf, "corpus").select("doc_id", "source", "filename", "label")
    numbered = dense_index(corpus, ["source"], ["doc_id"], id_chunk("doc_id"), "row_index")
    named = ensure_filename(F.col("filename"), F.col("label"), F.col("row_index"))
    return numbered.select("doc_id", "source", "row_index", named.alias("filename"))


@query(
    "content_preview",
    f"""select doc_id, substr(text, 1, 4000) as bounded, {q.strip('substr(text, 1, 120)')} as result_preview,
          replace(substr(text, 1, 220), chr(10), ' ') as error_preview from documents""",
)
def content_preview(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.substring(text, 1, MAX_CONTENT_CHARS).alias("bounded"),
        result_preview(text).alias("result_preview"),
        error_preview(text).alias("error_preview"),
    )


_PATHS = """select 'corpus' as origin, doc_id as id, filename as path from corpus
  union all select 'page', page_id, url from raw_pages"""


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    corpus = view(spark, sf, "corpus").select(F.lit("corpus").alias("origin"), F.col("doc_id").alias("id"), F.col("filename").alias("path"))
    pages = view(spark, sf, "raw_pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), F.col("url").alias("path"))
    return corpus.unionByName(pages)


@query(
    "featurize_name",
    f"""{with_views('corpus', 'raw_pages')}, paths as ({_PATHS})
        select origin, id, {q.featurize('path')} as features from paths""",
)
def featurize_name_query(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).select("origin", "id", featurize_name(F.col("path")).alias("features"))


@query(
    "path_suffixes",
    f"""{with_views('corpus', 'raw_pages')}, paths as ({_PATHS})
        select origin, id, array_to_string(list_sort(list_distinct({q.suffixes('path')})), ' ') as suffixes
        from paths""",
)
def path_suffixes_query(spark: SparkSession, sf: str) -> DataFrame:
    listed = F.array_join(F.sort_array(path_suffixes(F.col("path"))), " ")
    return _paths(spark, sf).select("origin", "id", listed.alias("suffixes"))


@query(
    "model_text_input",
    f"""{with_views('corpus')} select doc_id,
          {q.strip("'[FILE] ' || " + q.featurize('filename') + " || ' [CONTENT] ' || " + q.collapse('content'))} as text
        from corpus""",
)
def model_text_input_query(spark: SparkSession, sf: str) -> DataFrame:
    corpus = view(spark, sf, "corpus")
    return corpus.select("doc_id", model_text_input(F.col("filename"), F.col("content")).alias("text"))


@query(
    "label_encode",
    f"""{with_views('corpus')}, ids as (
          select label, row_number() over (order by label) - 1 as label_id from (select distinct label from corpus))
        select c.doc_id, c.label, i.label_id, coalesce(n.label, 'Other') as next_label
        from corpus c join ids i on c.label = i.label left join ids n on n.label_id = i.label_id + 1""",
)
def label_encode(spark: SparkSession, sf: str) -> DataFrame:
    corpus = view(spark, sf, "corpus").select("doc_id", "label")
    ids = label_ids(corpus)
    encoded = encode_labels(corpus, ids).withColumn("next_id", F.col("label_id") + 1)
    # Decoding the id after a row's own shows known ids and, after the last, the default.
    return decode_labels(encoded.withColumnRenamed("label", "own"), ids, "next_id").select(
        "doc_id", F.col("own").alias("label"), "label_id", F.col("label").alias("next_label")
    )


@query(
    "icon_lookup",
    f"{with_views('ops')} select id, category, {q.icon('category')} as icon from ops",
)
def icon_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "ops").select("id", "category", category_icon(F.col("category")).alias("icon"))


@query(
    "confidence_band",
    """select event_id, case when value / 100 >= 0.8 then 'high' when value / 100 >= 0.55 then 'medium'
         else 'low' end as band from events""",
)
def confidence_band_query(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", confidence_band(F.col("value") / 100).alias("band"))


@query(
    "source_filter",
    f"select doc_id, source from documents where lower({q.norm('lang')}) = 'en'",
)
def source_filter(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.where(matches_filters(docs, {"LANG": " En "})).select("doc_id", "source")


@query(
    "min_content",
    f"select doc_id, length({q.norm('text')}) as n_chars from documents where length({q.norm('text')}) >= 20",
)
def min_content_query(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", normalize_text(F.col("text")).alias("content"))
    return min_content(docs, 20).select("doc_id", F.char_length("content").cast("bigint").alias("n_chars"))


@query(
    "label_allowlist",
    f"""{with_views('ops')} select id, category from ops
        where category in ('Code','Docs','Finance','Study','Media','Archives','Logs','Other')""",
)
def label_allowlist(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "ops").where(F.col("category").isin(CATEGORIES)).select("id", "category")


_SPOTTED = """select doc_id, case doc_id % 5 when 0 then '/in/.' || source when 1 then '/in/~' || source
  when 2 then '/in/_' || source when 3 then '/in/.d/' || source else '' end as path from {documents}"""


@query(
    "ignore_hidden",
    f"""with spotted as ({_SPOTTED.format(documents='documents')})
        select doc_id, path from spotted
        where not starts_with({q.base_name('path')}, '.') and not starts_with({q.base_name('path')}, '~')
          and ({q.base_name('path')}) <> ''""",
)
def ignore_hidden(spark: SparkSession, sf: str) -> DataFrame:
    spotted = spark.sql(_SPOTTED, documents=table(spark, sf, "documents"))
    return spotted.where(visible_name(F.col("path")))
