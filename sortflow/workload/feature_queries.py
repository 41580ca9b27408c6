"""Tokens, n-grams and TF-IDF over whole documents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortflow.operators import features as ops
from sortflow.workload import sqltext as q
from sortflow.workload.registry import query, table

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
_CONTENT_WORDS = ops.FEATURE_BLOCKS[1]
_TEXT_WORDS = replace(_CONTENT_WORDS, column="text")

_GRAMS = f"""tokens as (select doc_id, {_WORDS} as w from documents),
  grams as (
    select doc_id, unnest(w) as term from tokens
    union all
    select doc_id, w[i] || ' ' || w[i + 1] from (select doc_id, w, unnest(range(1, len(w))) as i from tokens)),
  counts as (select doc_id, term, count(*) as tf from grams group by doc_id, term)"""

_KEPT = f"""kept as (
    select term, sum(tf) as total, count(*) as df from counts group by term
    order by total desc, term limit {_CONTENT_WORDS.max_features}),
  weights as (
    select c.doc_id, c.term, c.tf, k.df,
      c.tf * (ln((1 + (select count(*) from documents)) / (1 + k.df)) + 1) as weight
    from counts c join kept k on c.term = k.term)"""


@query("word_tokens", f"select doc_id, array_to_string({_WORDS}, ' ') as tokens from documents")
def word_tokens(spark: SparkSession, sf: str) -> DataFrame:
    words = ops.word_list(table(spark, sf, "documents"), "doc_id", "text")
    return words.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def _totals(spark: SparkSession, sf: str, block: ops.Block) -> DataFrame:
    return ops.term_totals(table(spark, sf, "documents"), "doc_id", block)


@query(
    "word_ngrams",
    f"with {_GRAMS} select term, sum(tf)::bigint as total, count(*) as df from counts group by term",
)
def word_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return _totals(spark, sf, _TEXT_WORDS)


@query(
    "char_ngrams",
    f"""with words as (
          select doc_id, ' ' || w || ' ' as p from (
            select doc_id, unnest(string_split({q.collapse('lower(text)')}, ' ')) as w from documents) where w <> ''),
        sized as (select doc_id, p, unnest([3, 4, 5]) as n from words),
        grams as (
          select doc_id, substr(p, unnest(range(1, greatest(length(p) - n + 1, 1) + 1)), n) as term
          from sized where n = 3 or length(p) >= n)
        select term, count(*) as total, count(distinct doc_id) as df from grams group by term""",
)
def char_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return _totals(spark, sf, replace(ops.FEATURE_BLOCKS[2], column="text", low=3, high=5))


@query("vocab_topk", f"with {_GRAMS}, {_KEPT} select term, total::bigint as total, df from kept")
def vocab_topk(spark: SparkSession, sf: str) -> DataFrame:
    return ops.top_terms(_totals(spark, sf, _TEXT_WORDS), _CONTENT_WORDS.max_features)


@query(
    "term_freq",
    f"""select doc_id, term, count(*) as tf from (select doc_id, unnest({_WORDS}) as term from documents)
        group by doc_id, term""",
)
def term_freq(spark: SparkSession, sf: str) -> DataFrame:
    return ops.document_terms(table(spark, sf, "documents"), "doc_id", replace(_TEXT_WORDS, high=1))


def _weights(spark: SparkSession, sf: str) -> DataFrame:
    return ops.block_tfidf(table(spark, sf, "documents"), "doc_id", _TEXT_WORDS)


@query("tfidf", f"with {_GRAMS}, {_KEPT} select doc_id, term, tf, df, round(weight, 6) as weight from weights")
def tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return _weights(spark, sf).select("doc_id", "term", "tf", "df", F.round("weight", 6).alias("weight"))


@query(
    "tfidf_l2",
    f"""with {_GRAMS}, {_KEPT}, norms as (select doc_id, sqrt(sum(weight * weight)) as norm from weights group by doc_id)
        select w.doc_id, w.term, round(w.weight / n.norm, 6) as weight
        from weights w join norms n on w.doc_id = n.doc_id""",
)
def tfidf_l2(spark: SparkSession, sf: str) -> DataFrame:
    scaled = ops.l2_normalised(_weights(spark, sf), "doc_id")
    return scaled.select("doc_id", "term", F.round("weight", 6).alias("weight"))
