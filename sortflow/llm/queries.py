"""The operators of this folder as queries over the driver's tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sortflow.llm.decontamination import contamination
from sortflow.llm.html_extraction import extract_text
from sortflow.llm.jaccard_join import link_components
from sortflow.llm.language_id import identify_languages, train_languages
from sortflow.llm.packing import pack_documents
from sortflow.llm.pii import KINDS, find_disclosures, spans_text
from sortflow.llm.rows import ROW
from sortflow.llm.sharding import shard_documents
from sortflow.llm.simhash_join import simhash_components
from sortflow.llm.substring_dedup import PASSAGE, remove_repeated_spans
from sortflow.llm.token_alignment import align_tokenizers
from sortflow.llm.topk_search import top_k
from sortflow.llm.toxicity import score_toxicity, train_toxicity
from sortflow.llm.vector_codes import ROUNDS, vector_codes

QUERIES = {}
ORACLES = {}
SHARDS = 24
TOXIC_FROM = 0.7
TOKENIZER = "word_bpe_49k.json"
ALIGNED = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(id_col: str = "doc_id") -> Column:
    """The third of the documents that no model learns from."""
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3
    return F.coalesce(fold == 1, F.lit(False))


@_query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = train_toxicity(docs, labels.where(~held_out()))
    scored = score_toxicity(docs.select("doc_id", "text"), model).select(F.col(ROW)["doc_id"].alias("doc_id"), "score")
    predicted = (F.col("score") >= TOXIC_FROM).cast("int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", predicted.alias("predicted"))


@_query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train_languages(docs.where(~held_out()))
    found = identify_languages(docs.select("doc_id", "text"), model)
    found = found.select(F.col(ROW)["doc_id"].alias("doc_id"), "lang_pred", "score", "bits_per_byte", "accepted")
    return found.withColumn("held_out", held_out())


@_query("op3_substring_dedup")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeated_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"), passage=PASSAGE)
    counts = ["n_sentences", "n_removed", "n_words_removed"]
    return cleaned.select(F.col(ROW)["doc_id"].alias("doc_id"), "text", *counts)


@_query("op4_html_extraction")
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select(F.col(ROW)["page_id"].alias("page_id"), F.col(ROW)["url"].alias("url"), "text", "n_chars")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@_query(
    "op5_decontamination",
    f"""
    with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
    b as (select item_id, {_WORDS.format("coalesce(text, '')")} as w from benchmark),
    items as (select item_id, w, least(10, len(w)) as k from b where len(w) > 0),
    needles as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as said
      from (select item_id, w, k, unnest(range(1, cast(len(w) as bigint) - k + 2)) as i from items)),
    sizes as (select distinct k from needles),
    hay as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as said
      from (select doc_id, w, k, unnest(range(1, cast(len(w) as bigint) - k + 2)) as i from d, sizes)),
    found as (select h.doc_id, h.i, h.k, n.item_id from hay h join needles n on h.k = n.k and h.said = n.said),
    hit as (select doc_id, count(distinct p) as n_hit
      from (select doc_id, unnest(range(i, i + k)) as p from found) group by doc_id),
    listed as (select doc_id, count(*) as n_items, list(x order by x) as items
      from (select distinct doc_id, cast(item_id as varchar) as x from found) group by doc_id)
    select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
      sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, n_hit is not null as contaminated
    from d left join hit using (doc_id) left join listed using (doc_id)
    """,
)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("items")


@_query("op6_ring_sharding")
def op6_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(_table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "home_shard",
    )


@_query("op7_tiered_packing")
def op7_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


@_query(
    "op8_jaccard_join",
    f"""
    with recursive d as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^ \\x09-\\x0D]+') as w from documents),
    shingles as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_transform(range(1, cast(len(w) as bigint) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from d),
    sizes as (select doc_id, count(*) as n from shingles group by doc_id),
    shared as (select a.doc_id as a, b.doc_id as b, count(*) as k
      from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
    links as (select t.a, t.b from shared t join sizes x on x.doc_id = t.a join sizes y on y.doc_id = t.b
      where 100 * k >= 90 * (x.n + y.n - k)),
    reach(a, b) as (select doc_id, doc_id from d union select r.a, l.b from reach r join links l on r.b = l.a)
    select d.doc_id, coalesce(n, 0) as n_shingles, component_id
    from d left join sizes using (doc_id) join (select a as doc_id, min(b) as component_id from reach group by a) using (doc_id)
    """,
)
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(_table(spark, sf_dir, "documents"), width=3, percent=90)


@_query("op9_disclosure")
def op9_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_disclosures(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("entities", lambda s: s["kind"])
    counts = [
        (F.size("entities") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)
    ]
    base = F.sha2(spans_text(F.col("entities")), 256)
    return found.select(F.col(ROW)["doc_id"].alias("doc_id"), *counts, base.alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


_SCALED = "list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint))"


@_query(
    "op10_max_score",
    f"""
    with v as (select vec_id, {_SCALED} as v from embeddings
      where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scored as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) as bigint) as score
      from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
    ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from scored)
    select query_id, rank, vec_id, score from ranked where rank <= 5
    """,
)
def op10_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


def _code_rounds(rounds: int) -> str:
    """Assignments ``a0`` to ``a<rounds>`` and the codebooks ``c1`` to ``c<rounds>`` made of them; ``m`` is distance and entry in one."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
    a{k} as materialized (select vec_id, part, min(d * 256 + entry) as m
      from (select vec_id, part, entry, cast(sum((x - c) * (x - c)) as bigint) as d from p join c{k} using (part, i) group by all) group by all),
    s{k} as materialized (select a.part, a.m % 256 as entry, i, count(*) as n, cast(sum(x) as bigint) as s
      from a{k} a join p using (vec_id, part) group by all),
    c{k + 1} as materialized (select part, entry, i, coalesce((s - ((s % n) + n) % n) // n, c) as c from c{k} left join s{k} using (part, entry, i))""")
    return ",".join(steps)


@_query(
    "op11_vector_codes",
    f"""
    with v as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
      from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    w as (select max(len(v)) // 4 as w from v),
    p as materialized (select vec_id, (k - 1) // w as part, (k - 1) % w as i, v[k] as x
      from (select vec_id, w, v, unnest(range(1, cast(len(v) as bigint) + 1)) as k from v, w)),
    first as (select vec_id, row_number() over (order by vec_id) - 1 as entry from v order by vec_id limit 256),
    c0 as materialized (select part, entry, i, x as c from p join first using (vec_id)),
    {_code_rounds(ROUNDS)},
    coded as (select vec_id, string_agg(format('{{:02x}}', m % 256), '' order by part) as code, cast(sum(m // 256) as bigint) as error
      from a{ROUNDS} group by vec_id)
    select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
      (select sha256(string_agg(cast(c as varchar), ',' order by part, entry, i)) from c{ROUNDS}) as codebooks_sha256
    from v join coded using (vec_id)
    """,
)
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_table(spark, sf_dir, "embeddings")).drop("label")


@_query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(_table(spark, sf_dir, "documents"), *map(tokenizer_path, ALIGNED))


@_query("op13_simhash")
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))
