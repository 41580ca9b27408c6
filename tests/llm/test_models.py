from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sortflow.llm import toxicity
from sortflow.llm.language_id import LanguageModel, identify_languages, keep_known_languages, train_languages
from sortflow.llm.queries import held_out
from sortflow.llm.rows import ROW
from sortflow.llm.toxicity import fit, score_toxicity, train_toxicity
from sortflow.llm.wordbytes import text_slices

SF = "/root/testdata/sf0.01"


def tree(texts: dict[str, list[str]], order: int) -> list[tuple[bytes, dict[str, int]]]:
    counts: dict[bytes, dict[str, int]] = {}
    for lang, said in texts.items():
        for raw in (t.encode() for t in said):
            for k in range(1, order + 2):
                for i in range(len(raw) - k + 1):
                    by = counts.setdefault(raw[i : i + k], {})
                    by[lang] = by.get(lang, 0) + 1
    return list(counts.items())


def plain_bits(grams: dict[bytes, dict[str, int]], lang: str, raw: bytes, order: int) -> float:
    """Code length by the rule: longest known context first, an escape for each that does not have the byte."""
    bits = 0.0
    for i in range(len(raw)):
        longest = max((k for k in range(min(order, i) + 1) if k == 0 or raw[i - k : i] in grams), default=0)
        for k in range(longest, -2, -1):
            if k < 0:
                bits += 8
                break
            context = raw[i - k : i]
            after = {g[k:]: c[lang] for g, c in grams.items() if len(g) == k + 1 and g[:k] == context and lang in c}
            n, d = sum(after.values()), len(after)
            if raw[i : i + 1] in after:
                bits -= math.log2(after[raw[i : i + 1]] / (n + d))
                break
            if n:
                bits -= math.log2(d / (n + d))
    return bits


def test_code_lengths_are_exact():
    r = random.Random(1)
    texts = {"xx": ["abracadabra", "abba é"], "yy": ["barbara", "zé zé"]}
    for order in (1, 2, 4):
        grams = tree(texts, order)
        model = LanguageModel(grams, order)
        said = ["", "abra", "zzé", "barQ", "a"] + ["".join(r.choice("abrczdé Q") for _ in range(12)) for _ in range(20)]
        bits = model.code_bits(next(text_slices(pa.array(said), lower=False)))
        for i, lang in enumerate(model.languages):
            expected = [plain_bits(dict(grams), lang, t.encode(), order) for t in said]
            np.testing.assert_allclose(bits[i], expected, atol=1e-9)


def test_every_sequence_of_the_sample_counts(spark):
    """Sequences seen once, and those of a rare language, beside more than 60,000 others."""
    r = random.Random(7)
    say = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(n))
    texts = {lang: [say(letters, 3_000)] * 2 for lang, letters in (("en", "abcdefghijklm"), ("de", "nopqrstuvwxyz"))}
    texts["es"] = [say("abcdefgñopqrs", 20) for _ in range(3)]
    model = train_languages(spark.createDataFrame([(t, lang) for lang, said in texts.items() for t in said], "text string, lang string"))
    grams = tree(texts, 4)
    assert sum(sum(by.values()) > 1 for _, by in grams) > 60_000
    assert sum(x.bit_count() for x in model.bits.tolist()) == len(grams)
    said = [texts["es"][0], texts["en"][0][:300], "ñabc xyz", "a"]
    bits = model.code_bits(next(text_slices(pa.array(said), lower=False)))
    few = {g: by for g, by in grams if any(g[:-1] in x.encode() for x in said[2:])}
    for i, lang in enumerate(model.languages):
        np.testing.assert_allclose(bits[i, 2:], [plain_bits(few, lang, x.encode(), 4) for x in said[2:]], atol=1e-9)
    np.testing.assert_allclose(bits, LanguageModel(grams, 4).code_bits(next(text_slices(pa.array(said), lower=False))), atol=1e-9)
    assert bits[model.languages.index("es"), 0] == bits[:, 0].min()


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train_languages(docs.where(~held_out()))
    found = identify_languages(docs, model).where(held_out(ROW + ".doc_id"))
    right = found.agg(F.avg((F.col("lang_pred") == F.col(ROW)["lang"]).cast("int"))).first()[0]
    assert right > 0.99
    assert docs.where(held_out()).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).count() == 0
    assert zlib.crc32(b"17") == spark.sql("select crc32(cast('17' as binary))").first()[0]


def test_unknown_languages(spark, documents):
    train = spark.createDataFrame([("the cat and the dog " * 5000, "en"), ("der Hund und die Katze " * 5000, "de"), ("x", None), (None, "fr")], "text string, lang string")
    model = train_languages(train)
    assert model.languages == ["de", "en"]
    docs = documents([(1, "the dog"), (2, None), (3, ""), (4, "123 !?"), (5, "Привет как дела"), (None, "die Katze"), (1, "the dog"), (6, "the " * 100_000)], extra="score double, letters long")
    rows = {(r[ROW]["doc_id"], r["lang_pred"], r["accepted"]) for r in identify_languages(docs, model).collect()}
    assert {(1, "en", True), (2, "und", False), (3, "und", False), (4, "und", False), (None, "de", True), (6, "en", True)} < rows
    assert (5, True) not in {(d, a) for d, _, a in rows}
    kept = keep_known_languages(docs, model)
    assert kept.columns == docs.columns and kept.count() == 4
    nothing = train_languages(train.where("lang = 'no'"))
    assert {r["lang_pred"] for r in identify_languages(docs, nothing).collect()} == {"und"}
    assert identify_languages(documents([]), model).count() == 0


def as_rows(texts):
    """Slots and borders of texts given as sets of slots."""
    slots = [sorted(t) for t in texts]
    return np.array([s for t in slots for s in t], np.int64), np.cumsum([0] + [len(t) for t in slots])


def plain_margin(bias, weights, factors, text):
    pairs = sum(float(np.dot(factors[i], factors[j])) for i in text for j in text if i < j)
    return bias + sum(weights[i] for i in text) + pairs / max(1, len(text))


def plain_fit(texts, toxic, epochs, table):
    """The same steps, slot by slot: a batch's gradients are added up, then every slot of the batch moves."""
    n, chance = len(texts), np.random.default_rng(toxicity.SEED)
    bias, width = math.log((sum(toxic) + 1) / (n - sum(toxic) + 1)), toxicity.FACTORS + 1
    random_start = chance.normal(0, toxicity.SPREAD, (table, toxicity.FACTORS))
    held = set().union(*texts)
    start = [[0.0, *(random_start[s] if s in held else [0.0] * toxicity.FACTORS)] for s in range(table)]
    now, pull, seen, seen_bias = [list(x) for x in start], [[0.0] * width for _ in start], [[0.0] * width for _ in start], 1.0
    for _ in range(epochs):
        order = chance.permutation(n).tolist()
        for begin in range(0, n, toxicity.BATCH):
            grads, all_errors = {}, 0.0
            for i in order[begin : begin + toxicity.BATCH]:
                text = texts[i]
                margin = plain_margin(bias, [x[0] for x in now], np.array([x[1:] for x in now]), text)
                error = 1 / (1 + math.exp(-margin)) - toxic[i]
                all_errors += error
                for s in text:
                    grad = grads.setdefault(s, [0.0] * width)
                    grad[0] += error
                    for f in range(1, width):
                        grad[f] += error / len(text) * sum(now[o][f] for o in text if o != s)
            for s, grad in grads.items():
                for f, g in enumerate(grad):
                    before, after = math.sqrt(seen[s][f]), math.sqrt(seen[s][f] + g * g)
                    seen[s][f] += g * g
                    pull[s][f] += g - (after - before) / toxicity.RATE * (now[s][f] - start[s][f])
                    strong = max(0.0, abs(pull[s][f]) - (toxicity.LEAST_FACTOR if f else toxicity.LEAST_WEIGHT))
                    now[s][f] = start[s][f] - math.copysign(strong, pull[s][f]) * toxicity.RATE / (toxicity.STEADY + after)
            seen_bias += all_errors**2
            bias -= toxicity.RATE * all_errors / math.sqrt(seen_bias)
    return bias, np.array(now)


def drawn(n, label, seed=1, fillers=50):
    r, texts, toxic = random.Random(seed), [], []
    for _ in range(n):
        a, b = r.random() < 0.5, r.random() < 0.5
        texts.append({10 + r.randrange(fillers)} | ({1} if a else set()) | ({2} if b else set()))
        toxic.append(float(label(a, b)))
    return texts, np.array(toxic)


def test_training_agrees_with_a_plain_loop():
    texts, toxic = drawn(400, lambda a, b: a and b)
    texts[7] = set()
    model = fit(*as_rows(texts), toxic, epochs=3, table=64)
    bias, now = plain_fit(texts, toxic.tolist(), 3, 64)
    assert math.isclose(model.bias, bias, rel_tol=1e-6)
    np.testing.assert_allclose(model.weights, now[:, 0], atol=1e-8)
    np.testing.assert_allclose(model.factors, now[:, 1:], atol=1e-8)
    assert np.abs(model.weights).max() > 0.1
    margins = [plain_margin(bias, now[:, 0], now[:, 1:], t) for t in texts[:20]]
    np.testing.assert_allclose(model.margins(*as_rows(texts[:20])), margins, atol=1e-6)


def auc_of(score, label):
    rank = score.argsort().argsort() + 1
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


@pytest.mark.parametrize("fillers", [50, 5_000])
def test_pairs_mean_what_no_term_means_alone(fillers):
    """Toxic if both terms stand in a text, or neither: no term says anything by itself."""
    texts, toxic = drawn(6_000, lambda a, b: a == b, fillers=fillers)
    model = fit(*as_rows(texts[:4_000]), toxic[:4_000])
    assert auc_of(model.margins(*as_rows(texts[4_000:])), toxic[4_000:]) > 0.95


def test_interaction_is_learnt():
    texts, toxic = drawn(3_000, lambda a, b: a and b, seed=4)
    model = fit(*as_rows(texts), toxic)
    one, other, both = model.margins(*as_rows([{1, 10}, {2, 10}, {1, 2, 10}]))
    assert both > 2 and max(one, other) < -2
    assert model.factors[1] @ model.factors[2] > 0.5


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = train_toxicity(docs, labels.where(~held_out()))
    scored = score_toxicity(docs.where(held_out()), model).select(F.col(ROW)["doc_id"].alias("doc_id"), "score")
    rows = scored.join(labels, "doc_id").select("score", "toxic").toPandas()
    assert rows.score.between(0, 1).all()
    order = rows.score.rank()
    positive = rows.toxic == 1
    auc = (order[positive].sum() - positive.sum() * (positive.sum() + 1) / 2) / (positive.sum() * (~positive).sum())
    assert auc > 0.95
    assert rows[rows.score >= 0.7].toxic.mean() > 0.95


def test_odd_labels(spark, documents):
    docs = documents([(1, "bad bad"), (2, None), (3, ""), (None, "bad"), (1, "bad bad")], extra="score double, toxic int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    rows = score_toxicity(docs, train_toxicity(docs, labels)).collect()
    assert len(rows) == 5 and len({r["score"] for r in rows}) == 1 and 0 < rows[0]["score"] < 1
    assert {r["score"] for r in score_toxicity(docs, train_toxicity(docs, labels.limit(0))).collect()} == {0.5}
    assert score_toxicity(documents([]), train_toxicity(documents([]), labels)).count() == 0


def test_sequences_of_training_rows_are_counted_some_at_a_time():
    """What a task holds beside its batch does not grow with the batch, and nothing is lost."""
    import pyarrow as pa

    from sortflow.llm import language_id

    texts = ["ab cd ef gh " * 1_000] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 50), pa.array(texts)], ["lang", "text"])
    sums = [sum(found.column(2).to_pylist()) for found in language_id._count_grams(4)([batch])]
    assert max(sums) <= 5 * language_id._SLICE
    assert sum(sums) == sum(len(t) - n for t in texts for n in range(5))
