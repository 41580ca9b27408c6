from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import compare
from sortflow.llm.queries import ORACLES, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op2_language_id": "doc_id:bigint held_out:boolean lang_pred:string score:double",
    "op3_substring_dedup": "doc_id:bigint text:string n_sentences:bigint n_removed:bigint n_words_removed:bigint",
    "op4_html_extraction": "page_id:bigint url:string text:string n_chars:bigint",
    "op5_decontamination": "doc_id:bigint n_words:bigint n_hit:bigint n_items:bigint items_sha256:string contaminated:boolean",
    "op6_ring_sharding": "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
    "op7_tiered_packing": "doc_id:bigint start:bigint length:bigint ids_crc32:bigint doc_tokens:bigint sequence_id:bigint offset:bigint",
    "op8_jaccard_join": "doc_id:bigint n_shingles:bigint component_id:bigint",
    "op9_disclosure": "doc_id:bigint n_email:bigint n_ip:bigint n_card:bigint n_phone:bigint base_sha256:string spans:string",
    "op10_max_score": "query_id:bigint rank:int vec_id:bigint score:bigint",
    "op11_vector_codes": "vec_id:bigint code:string error:bigint label_error:bigint codebooks_sha256:string",
    "op12_token_alignment": "doc_id:bigint n_a:bigint n_b:bigint n_groups:bigint n_links:bigint n_best:bigint count_sum:bigint groups_sha256:string",
    "op13_simhash": "doc_id:bigint fingerprint:string component_id:bigint",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), SF, ORACLES[name]) is None


def test_there_is_one_query_of_each():
    assert sorted(QUERIES) == sorted(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    kinds = dict(QUERIES[name](spark, SF).dtypes)
    assert {c: kinds.get(c) for c in (x.split(":")[0] for x in COLUMNS[name].split())} == dict(x.split(":") for x in COLUMNS[name].split())


def made(r: random.Random):
    words = {
        "en": "the and of that with from this they have not are was which their".split(),
        "de": "der die das und nicht mit von ist auf eine den für sich auch".split(),
    }
    say = lambda lang, n: " ".join(r.choice(words[lang]) + r.choice("abcdefgh") * r.choice([0, 1, 2]) for _ in range(n))
    docs = [(i, say(("en", "de")[i % 2], 80), ("en", "de")[i % 2]) for i in range(120)]
    docs += [(200, docs[4][1], "en"), (201, docs[5][1] + " Ende.", "de"), (202, docs[5][1] + " Ende. Schluss.", "de")]
    item = say("en", 15)
    docs += [(210, f"{say('en', 30)} {item.upper()} {say('en', 30)}", "en"), (211, say("en", 40) + " write to me@here.org or 10.0.0.7 now", "en")]
    docs += [(220, None, "en"), (221, "", None), (222, "12345 !!", "de"), (223, "Съешь ещё этих мягких французских булок " * 3, None)]
    return docs, item


def test_every_stage_of_the_pipeline(spark, tmp_path):
    docs, item = made(random.Random(2))
    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in docs]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = at
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in kept.items()}
    everything = {i for i, *_ in docs}
    assert ids["language"] == everything - {220, 221, 222, 223}
    assert ids["near_copies"] == ids["language"] - {200, 201, 202}
    assert ids["benchmark"] == ids["near_copies"] - {210}
    assert ids["personal_data"] == ids["benchmark"] == ids["packing"]
    texts = {r.doc_id: r for r in kept["personal_data"].collect()}
    assert texts[211].text.endswith("write to [EMAIL] or [IP] now") and texts[211].n_chars == len(texts[211].text)
    assert all(texts[i].text == dict((d, t) for d, t, _ in docs)[i] for i in texts if i != 211)

    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    sizes = {i: len(model.encode(x.text, add_special_tokens=False).ids) + 1 for i, x in texts.items()}
    packed = kept["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("m")).collect()
    assert {r.doc_id: (r.n, r.m) for r in packed} == {i: (n, n) for i, n in sizes.items()}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.select("doc_id", "start", "length").collect()))[:5] and whole.agg(F.sum("length")).first()[0] == sum(sizes.values())


def test_pipeline_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
