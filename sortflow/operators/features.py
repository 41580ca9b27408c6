"""TF-IDF over words and characters: as relational tables, and as a fitted ML pipeline."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sortflow.functions.ngrams import (
    blank_separated,
    padded_words,
    word_tokens,
)
from sortflow.operators.vectors import TextVectors
from sortflow.plans.once import computed_once


@dataclass(frozen=True)
class Block:
    """One TF-IDF block: terms of one text column, capped at the most frequent ``max_features``."""

    name: str
    column: str
    analyzer: str
    low: int
    high: int
    max_features: int


# The three blocks of the classifier.
FEATURE_BLOCKS = (
    Block("name_chars", "filename", "char", 2, 4, 5_000),
    Block("content_words", "content", "word", 1, 2, 10_000),
    Block("content_chars", "content", "char", 3, 5, 8_000),
)

MAX_BROADCAST_TERMS = 100_000


#: Bytes of text of one partition of documents: what a task counts does not grow with the table.
PARTITION_BYTES = 8 << 20
#: Bytes of text under one id that a task counts in a dictionary; ids with more are counted by Spark.
DOCUMENT_BYTES = 1 << 20
#: Rows of a batch that a task returns.
_BATCH = 100_000


def text_bytes(docs: DataFrame, id_col: str, text: str) -> tuple[int, int]:
    """(bytes of all texts, most bytes under one id)."""
    sizes = docs.groupBy(id_col).agg(F.sum(F.octet_length(text)).alias("__n"))
    found = sizes.agg(F.sum("__n").alias("total"), F.max("__n").alias("most")).first()
    return found["total"] or 0, found["most"] or 0


def _by_document(docs: DataFrame, id_col: str, text: str, total: int | None = None) -> DataFrame:
    """Place each document once; all later grouping by document, or document and term, stays in place.

    Terms take far more memory than the texts they are cut from, so the number
    of partitions follows the bytes of text.
    """
    total = text_bytes(docs, id_col, text)[0] if total is None else total
    return docs.select(id_col, F.col(text).alias("__text")).repartition(total // PARTITION_BYTES + 1, id_col)


def word_list(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, tokens) per document."""
    return docs.select(id_col, F.expr(word_tokens(f"`{text}`")).alias("tokens"))


def word_occurrences(docs: DataFrame, id_col: str, text: str, high: int = 2) -> DataFrame:
    """(id, term, n): words and, for ``high`` = 2, pairs of neighbouring words, as they occur."""
    return _placed_words(_by_document(docs, id_col, text), id_col, high)


def _placed_words(texts: DataFrame, id_col: str, high: int) -> DataFrame:
    if high not in (1, 2):
        raise ValueError("Word n-grams go up to pairs.")
    placed = computed_once(texts, [id_col], {"__tokens": F.expr(word_tokens("__text"))})
    # Terms are cut by position, which stays in generated code; a lambda over the array would not.
    at = placed.select(id_col, "__tokens", F.explode(F.sequence(F.lit(0), F.size("__tokens") - 1)).alias("__i"))
    at = at.where("__i < size(__tokens) and __i >= 0")
    word, following = F.get("__tokens", F.col("__i")), F.get("__tokens", F.col("__i") + 1)
    pair = F.concat(word, F.lit(" "), following)
    terms = at.select(id_col, F.explode(F.array(word, pair) if high == 2 else F.array(word)).alias("term"))
    return terms.where("term is not null").withColumn("n", F.lit(1).cast("bigint"))


def char_occurrences(docs: DataFrame, id_col: str, text: str, low: int, high: int) -> DataFrame:
    """(id, term, n): character n-grams inside words, ``n`` times the word that holds them.

    Equal words of a document are counted first, so grams are cut once per
    distinct word of a document.
    """
    return _placed_grams(_by_document(docs, id_col, text), id_col, low, high)


def _placed_grams(texts: DataFrame, id_col: str, low: int, high: int) -> DataFrame:
    words = (
        texts.select(id_col, F.explode(F.expr(padded_words("__text"))).alias("__word"))
        .groupBy(id_col, "__word")
        .agg(F.count("*").alias("__n"))
    )
    # Two generators instead of nested lambdas: gram sizes, then positions, in generated code.
    size, length = F.col("__size"), F.char_length("__word")
    sized = words.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("__size"))
    sized = sized.where((size == low) | (length >= size))
    placed = sized.select(
        "*", F.explode(F.sequence(F.lit(1), F.greatest(length - size + 1, F.lit(1)))).alias("__at")
    )
    return placed.select(id_col, F.substring("__word", F.col("__at"), size).alias("term"), F.col("__n").alias("n"))


def occurrences(docs: DataFrame, id_col: str, block: Block) -> DataFrame:
    return _placed_occurrences(_by_document(docs, id_col, block.column), id_col, block)


def _placed_occurrences(texts: DataFrame, id_col: str, block: Block) -> DataFrame:
    if block.analyzer == "word":
        return _placed_words(texts, id_col, block.high)
    return _placed_grams(texts, id_col, block.low, block.high)


def term_counts(found: DataFrame, id_col: str) -> DataFrame:
    """(id, term, tf). Documents are in place, so this needs no shuffle."""
    return found.groupBy(id_col, "term").agg(F.sum("n").alias("tf"))


class _Words:
    """Words and pairs of documents, counted by dictionaries."""

    def __init__(self, high: int) -> None:
        self.high = high
        self.clear()

    def clear(self) -> None:
        self.lengths, self.terms, self.tfs, self.own = [], [], [], Counter()

    def add(self, text: str) -> None:
        words = text.split(" ") if text else []
        self.own.update(words)
        if self.high == 2:
            self.own.update(map(" ".join, zip(words, words[1:])))

    def close(self) -> bool:
        """End a document; whether it has terms."""
        own, self.own = self.own, Counter()
        if own:
            self.lengths.append(len(own))
            self.terms.extend(own.keys())
            self.tfs.extend(own.values())
        return bool(own)

    @property
    def full(self) -> bool:
        return len(self.terms) >= _BATCH

    def take(self) -> tuple[list[int], list[pa.Array]]:
        lengths, columns = self.lengths, [pa.array(self.terms, pa.string()), pa.array(self.tfs, pa.int64())]
        self.clear()
        return lengths, columns


class _Grams:
    """Character n-grams of the words of documents, as numbers: the ranks of their characters, ``bits`` for each.

    Words are parted by one blank, so the grams of padded words are the runs of
    characters without a blank inside. A document with more characters than
    ranks is counted by its strings.
    """

    def __init__(self, low: int, high: int, totals: bool) -> None:
        self.low, self.high, self.totals, self.bits = low, high, totals, 63 // high
        self.rank, self.letters, self.overflow = None, [], True
        self.text: list[str] = []
        self.clear()

    def clear(self) -> None:
        self.lengths, self.keys, self.tfs, self.strings, self.rows = [], [], [], [], 0
        if self.overflow:
            self.rank, self.letters, self.overflow = np.zeros(0x110000, np.int32), [0, 32], False
            self.rank[32] = 1

    def add(self, text: str) -> None:
        self.text += [w for w in text.split(" ") if w]

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        counts = Counter()
        for word, times in Counter(words).items():
            padded = f" {word} "
            sizes = [n for n in range(self.low, self.high + 1) if n == self.low or len(padded) >= n]
            for gram in [padded[i : i + n] for n in sizes for i in range(max(len(padded) - n + 1, 1))]:
                counts[gram] += times
        first = -len(self.strings) - 1
        self.strings.extend(counts.keys())
        return np.arange(first, first - len(counts), -1), np.fromiter(counts.values(), np.int64, len(counts))

    def _counted(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.low not in (2, 3):
            return self._plain(words)
        chars = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32)
        ranks = self.rank[chars]
        new = np.unique(chars[ranks == 0])
        if len(new):
            if len(self.letters) + len(new) > 1 << self.bits:
                self.overflow = True
                return self._plain(words)
            self.rank[new] = np.arange(len(self.letters), len(self.letters) + len(new))
            self.letters += new.tolist()
            ranks = self.rank[chars]
        ranks, blank, found = ranks.astype(np.int64), ranks == 1, []
        key, inside = ranks << self.bits * (self.high - 1), np.ones(len(ranks), bool)
        for n in range(2, min(self.high, len(ranks)) + 1):
            runs = len(ranks) - n + 1
            key = key[:runs] | ranks[n - 1 :] << self.bits * (self.high - n)
            inside = inside[:runs] if n == 2 else inside[:runs] & ~blank[n - 2 : n - 2 + runs]
            if n >= self.low:
                found.append(key[inside])
        keys = np.sort(np.concatenate(found))
        at = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[at], np.diff(at, append=len(keys))

    def close(self) -> bool:
        """End a document; whether it has terms."""
        words, self.text = self.text, []
        if not words:
            return False
        keys, tfs = self._counted(words)
        self.keys.append(keys)
        self.tfs.append(tfs)
        self.lengths.append(len(keys))
        self.rows += len(keys)
        return True

    @property
    def full(self) -> bool:
        return self.overflow or self.rows >= _BATCH * 10

    def _names(self, keys: np.ndarray) -> list[str]:
        own = int(np.searchsorted(keys, 0))
        shifts = self.bits * np.arange(self.high - 1, -1, -1)
        ranks = keys[own:, None] >> shifts & (1 << self.bits) - 1
        text = np.array(self.letters, "<u4")[ranks[ranks > 0]].tobytes().decode("utf-32-le")
        ends = np.cumsum((ranks > 0).sum(axis=1)).tolist()
        return [self.strings[-k - 1] for k in keys[:own].tolist()] + [text[a:b] for a, b in zip([0, *ends], ends)]

    def take(self) -> tuple[list[int], list[pa.Array]]:
        keys, tfs = (np.concatenate(part or [np.zeros(0, np.int64)]) for part in (self.keys, self.tfs))
        distinct, gram = np.unique(keys, return_inverse=True)
        names, lengths = pa.array(self._names(distinct), pa.string()), self.lengths
        if self.totals:
            total = np.bincount(gram, tfs, minlength=len(distinct)).astype(np.int64)
            columns = [names, pa.array(total), pa.array(np.bincount(gram, minlength=len(distinct)))]
        else:
            columns = [names.take(pa.array(gram)), pa.array(tfs)]
        self.clear()
        return lengths, columns


def _count_documents(kind: type, low: int, high: int, totals: bool):
    """(id, term, tf), or (term, total, df) of runs of documents, of rows (id, first, words).

    The rows of an id come one after another; ``first`` begins an id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Words(high) if kind is _Words else _Grams(low, high, totals)
        ids, own, name = [], None, None

        def flush() -> pa.RecordBatch:
            lengths, columns = counter.take()
            if totals:
                return pa.RecordBatch.from_arrays(columns, ["term", "total", "df"])
            rows = pa.array(np.repeat(np.arange(len(ids)), lengths))
            columns = [pa.concat_arrays(ids).take(rows), *columns]
            ids.clear()
            return pa.RecordBatch.from_arrays(columns, [name, "term", "tf"])

        for batch in batches:
            name = batch.schema.names[0]
            for i, (first, words) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if first:
                    if counter.close() and not totals:
                        ids.append(own)
                    own = batch.column(0).slice(i, 1)
                    if counter.full:
                        yield flush()
                if words:
                    counter.add(words)
        if counter.close() and not totals:
            ids.append(own)
        if totals or ids:
            yield flush()

    return run


def _by_id(docs: DataFrame, id_col: str, block: Block) -> tuple[DataFrame, DataFrame | None]:
    """((id, first, words) in order of ids, texts of ids above ``DOCUMENT_BYTES`` if there are any)."""
    total, most = text_bytes(docs, id_col, block.column)
    texts = _by_document(docs, id_col, block.column, total)
    large = None
    if most > DOCUMENT_BYTES:
        size = F.coalesce(F.sum(F.octet_length("__text")).over(W.partitionBy(id_col)), F.lit(0))
        texts = texts.withColumn("__size", size)
        large, texts = texts.where(F.col("__size") > DOCUMENT_BYTES), texts.where(F.col("__size") <= DOCUMENT_BYTES)
    if block.analyzer == "word":
        words = F.array_join(F.expr(word_tokens("__text")), " ")
    else:
        words = F.expr(blank_separated("__text"))
    first = F.row_number().over(W.partitionBy(id_col).orderBy(id_col)) == 1
    return texts.select(id_col, first.alias("__first"), "__text").select(id_col, "__first", words.alias("__words")), large


def _counter(block: Block, totals: bool):
    if block.analyzer == "word" and block.high not in (1, 2):
        raise ValueError("Word n-grams go up to pairs.")
    return _count_documents(_Words if block.analyzer == "word" else _Grams, block.low, block.high, totals)


def document_terms(docs: DataFrame, id_col: str, block: Block) -> DataFrame:
    """(id, term, tf) of one block: the counts of :func:`term_counts` over :func:`occurrences`, a document at a time.

    Texts are placed and sorted by id, so a task holds the terms of a few ids and
    no row per occurrence leaves it. Rows that share an id, null included, are
    one document. An id of more than ``DOCUMENT_BYTES`` goes by :func:`term_counts`.
    """
    run = _counter(block, totals=False)
    rows, large = _by_id(docs, id_col, block)
    fields = [docs.select(id_col).schema[0], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]
    counted = rows.mapInArrow(run, T.StructType(fields))
    return counted if large is None else counted.unionByName(term_counts(_placed_occurrences(large, id_col, block), id_col))


def term_totals(docs: DataFrame, id_col: str, block: Block) -> DataFrame:
    """(term, total, df) of all terms of one block; of grams, which are few, tasks return no row per document."""
    if block.analyzer == "word":
        return document_terms(docs, id_col, block).groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    run = _counter(block, totals=True)
    rows, large = _by_id(docs, id_col, block)
    parts = rows.mapInArrow(run, "term string, total long, df long")
    if large is not None:
        counts = term_counts(_placed_occurrences(large, id_col, block), id_col)
        parts = parts.unionByName(counts.select("term", F.col("tf").alias("total"), F.lit(1).cast("bigint").alias("df")))
    return parts.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def vocabulary(counts: DataFrame, max_features: int) -> DataFrame:
    """(term, total, df) of the terms with the highest total count; ties go by term."""
    return top_terms(counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")), max_features)


def top_terms(totals: DataFrame, max_features: int) -> DataFrame:
    return totals.orderBy(F.desc("total"), "term").limit(max_features)


def smooth_idf(documents: Column, df: Column) -> Column:
    return F.log((F.lit(1) + documents) / (F.lit(1) + df)) + 1


def tfidf(docs: DataFrame, found: DataFrame, id_col: str, max_features: int) -> DataFrame:
    """(id, term, tf, df, weight) for the kept terms of the occurrences ``found``."""
    counts = term_counts(found, id_col)
    return _weighted(docs, counts, vocabulary(counts, max_features), id_col, max_features)


def block_tfidf(docs: DataFrame, id_col: str, block: Block) -> DataFrame:
    """(id, term, tf, df, weight) for the kept terms of one block."""
    kept = top_terms(term_totals(docs, id_col, block), block.max_features)
    return _weighted(docs, document_terms(docs, id_col, block), kept, id_col, block.max_features)


def _weighted(docs: DataFrame, counts: DataFrame, kept: DataFrame, id_col: str, max_features: int) -> DataFrame:
    """The vocabulary has at most ``max_features`` rows by construction; it is broadcast when that bound is small.

    The number of documents is a scalar subquery.
    """
    documents = docs.agg(F.count("*")).scalar()
    kept = kept.select("term", "df", smooth_idf(documents, F.col("df")).alias("__idf"))
    if max_features <= MAX_BROADCAST_TERMS:
        kept = F.broadcast(kept)
    counted = counts.join(kept, "term")
    return counted.select(id_col, "term", "tf", "df", (F.col("tf") * F.col("__idf")).alias("weight"))


def l2_normalised(weights: DataFrame, id_col: str) -> DataFrame:
    """Scale each document's weights to length 1; documents stay where they are."""
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy(id_col)))
    return weights.withColumn("weight", F.col("weight") / norm)


def fit_feature_stages(
    train: DataFrame, id_col: str, blocks: tuple[Block, ...] = FEATURE_BLOCKS
) -> list:
    """Fitted stages from (filename features, content) to one sparse ``features`` vector.

    Vocabularies and document frequencies come from the relational tables
    above; only the capped vocabulary of each block reaches the driver.
    """
    documents = train.count()
    vocabularies = []
    for block in blocks:
        kept = top_terms(term_totals(train, id_col, block), block.max_features)
        rows = kept.select("term", smooth_idf(F.lit(documents), F.col("df")).alias("idf")).collect()
        vocabularies.append(
            {
                "column": block.column,
                "analyzer": block.analyzer,
                "terms": [r.term for r in rows],
                "idf": [r.idf for r in rows],
            }
        )
    return [TextVectors(vocabularies)]


def fit_features(
    train: DataFrame, id_col: str, blocks: tuple[Block, ...] = FEATURE_BLOCKS
) -> PipelineModel:
    return PipelineModel(fit_feature_stages(train, id_col, blocks))
