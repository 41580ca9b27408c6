"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a tree of byte contexts of up to ``ORDER`` bytes with the
counts of the bytes that followed. A byte costs -log2 of its share in the
longest context known; where it has not been seen, the escape probability is
paid (method C: distinct followers / (followers + distinct followers)) and the
next shorter context is asked, down to a uniform byte. The statistics are frozen
after training, so the length of the code of a text is an exact sum of table
entries. The language with the shortest code wins, its name included, which
costs -log2 of its share of the labelled rows.

Training reads about ``max_docs`` labelled rows per language, which bounds the
model, and keeps every byte sequence of theirs. The trees are broadcast packed: the
followers of a context are a bit set and the number of the first of them. Scoring
reads every byte of every text, in one pass without a shuffle.

Defined results: a null, empty or letterless text is ``und`` with score 0; equal
code lengths go to the first language by name; without labelled rows everything
is ``und``; repeated rows get equal results; empty tables give no rows; columns
other than those named are passed on untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sortflow.llm.rows import ROW, text_of, unpack, whole_row
from sortflow.llm.wordbytes import Texts, text_slices

ORDER = 4
MAX_DOCS = 4_000
#: A text that takes more bits a byte in its best language is in none of them: a byte no language has shown
#: costs over 20 bits, numbers and keys among words 8 to 12.
MAX_BITS = 16.0
UNKNOWN = "und"
_SLICE = 1 << 18
#: Rows of an Arrow batch that are worked on at once: beside the batch, memory holds what these take.
_PIECE = 500


def _count_grams(order: int):
    """Counts of all byte sequences of 1 to order + 1 bytes: key is length * 256^5 and the bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                for texts in text_slices(batch.column(1).filter(pa.array(langs == lang)), _SLICE, lower=False):
                    keys = []
                    data = texts.data.astype(np.int64)
                    place = np.arange(len(data)) - np.repeat(texts.offsets[:-1], np.diff(texts.offsets))
                    key = np.zeros(len(data), np.int64)
                    for length in range(1, order + 2):
                        key[length - 1 :] |= data[: len(data) - length + 1] << (8 * (length - 1))
                        keys.append(key[place >= length - 1] | (length << 40))
                    found, n = np.unique(np.concatenate(keys), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array(n, pa.int64())],
                        ["lang", "gram", "n"],
                    )

    return count


def _key_of(gram: bytes) -> int:
    """Key of a byte sequence, as it is counted."""
    return len(gram) << 40 | int.from_bytes(gram, "big")


class LanguageModel:
    """Context trees of all languages in one tree, with a table of costs per language."""

    def __init__(self, grams: list[tuple[bytes, dict[str, int]]], order: int, rows: dict[str, int] | None = None) -> None:
        counted = [(_key_of(gram), lang, n) for gram, by_lang in grams for lang, n in by_lang.items()]
        keys, langs, n = zip(*counted) if counted else ((), (), ())
        self._fit(np.array(keys, np.int64), np.array(langs, object), np.array(n, np.int64), order, rows)

    @classmethod
    def of_counts(cls, counted: pa.Table, order: int, rows: dict[str, int] | None = None) -> LanguageModel:
        """Model of a table (gram, lang, n) of counted keys."""
        model = cls.__new__(cls)
        langs = counted["lang"].combine_chunks().dictionary_encode()
        names = np.array(langs.dictionary.to_pylist(), object)[langs.indices.to_numpy()] if len(langs) else np.zeros(0, object)
        model._fit(counted["gram"].to_numpy(), names, counted["n"].to_numpy(), order, rows)
        return model

    def _fit(self, gram: np.ndarray, lang: np.ndarray, n: np.ndarray, order: int, rows: dict[str, int] | None) -> None:
        self.order = order
        self.languages = sorted(set(lang))
        shares = np.array([(rows or {}).get(name, 1) for name in self.languages], np.float64)
        self.name_bits = -np.log2(shares / shares.sum())
        #: Node i stands for keys[i]: shorter sequences first, then by byte; node 0 is the empty sequence.
        keys = np.unique(np.append(gram, 0))
        length, said = keys >> 40, keys & ((1 << 40) - 1)
        size, languages = len(keys), len(self.languages)
        last = said & 255
        parent = np.searchsorted(keys, np.maximum(length - 1, 0) << 40 | said >> 8)
        shorter = np.searchsorted(keys, np.maximum(length - 1, 0) << 40 | said & ((1 << 8 * np.maximum(length - 1, 0)) - 1))
        self.symbol = np.zeros(256, np.int64)
        seen = np.unique(last[1:])
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        #: Sequences of full length have no followers; the last row is that of sequences not seen.
        inner = int(np.count_nonzero(length <= order))
        self.dead = inner
        self.words = (len(seen) + 64) // 64
        slot = parent[1:] * self.words + (self.symbol[last[1:]] >> 6)
        self.bits = np.zeros((inner + 1) * self.words, np.uint64)
        np.bitwise_or.at(self.bits, slot, np.uint64(1) << (self.symbol[last[1:]] & 63).astype(np.uint64))
        self.first = np.zeros((inner + 1) * self.words, np.int64)
        used, at = np.unique(slot, return_index=True)
        self.first[used] = at + 1
        counts = np.zeros((size, languages))
        counts[np.searchsorted(keys, gram), np.searchsorted(self.languages, list(lang)) if languages else []] = n
        total, kinds = np.zeros((size, languages)), np.zeros((size, languages))
        np.add.at(total, parent[1:], counts[1:])
        np.add.at(kinds, parent[1:], counts[1:] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            own = -np.log2(counts / (total + kinds)[parent])
        falls = escape.copy()
        cost = np.full((size, languages), 8.0)
        for k in range(1, order + 2):
            i = slice(*np.searchsorted(length, [k, k + 1]))
            if k <= order:
                falls[i] += falls[shorter[i]]
            cost[i] = np.where(counts[i] > 0, own[i], escape[parent[i]] + cost[shorter[i]])
        cost[1:] -= falls[parent[1:]]
        self.cost = np.ascontiguousarray(cost.T)
        self.falls = np.ascontiguousarray(falls[:inner].T)

    def _child(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The node of a sequence and one byte more, -1 if it was not seen."""
        slot = node * self.words + (symbol >> 6)
        bits, at = self.bits[slot], (symbol & 63).astype(np.uint64)
        below = np.bitwise_count(bits & ((np.uint64(1) << at) - np.uint64(1)))
        return np.where(bits >> at & np.uint64(1), self.first[slot] + below, -1)

    def code_bits(self, texts: Texts) -> np.ndarray:
        """Code length in bits of every text in every language."""
        out = np.zeros((len(self.languages), texts.rows))
        full = np.flatnonzero(np.diff(texts.offsets))
        if not len(full):
            return out
        first = texts.offsets[:-1][full]
        symbol = self.symbol[texts.data]
        node = np.zeros(len(symbol), np.int64)
        matched = np.zeros(len(symbol), np.int64)
        for length in range(1, self.order + 2):
            if length == 1:
                before = node
            else:
                before = np.empty_like(node)
                before[1:] = node[:-1]
                before[first] = -1
                before[before < 0] = self.dead
            node = self._child(before, symbol)
            alive = node >= 0
            if length == self.order + 1:
                context = matched.copy()
            np.copyto(matched, node, where=alive)
        known = np.zeros_like(context)
        known[1:] = context[:-1]
        known[first] = 0
        for i in range(len(self.languages)):
            out[i, full] = np.add.reduceat(self.cost[i][matched] + self.falls[i][known], first)
        return out

    def predict(self, column: pa.Array) -> tuple[list, list, list]:
        """Best language, its share among the languages, and its bits per byte, for every text."""
        best, score, bits = [], [], []
        for texts in text_slices(column, _SLICE, lower=False):
            text_bits = self.code_bits(texts)
            code = text_bits + self.name_bits[:, None]
            top = code.argmin(axis=0)
            least = code[top, np.arange(texts.rows)]
            best += [self.languages[i] for i in top]
            score += (1 / np.exp2(np.minimum(0, least - code)).sum(axis=0)).tolist()
            bits += (text_bits[top, np.arange(texts.rows)] / np.maximum(1, np.diff(texts.offsets))).tolist()
        return best, score, bits


def train_languages(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    order: int = ORDER,
    max_docs: int = MAX_DOCS,
) -> LanguageModel:
    """Fit on about ``max_docs`` rows of each language, chosen by a hash of the row."""
    if not 1 <= order <= 4:
        raise ValueError("Contexts of 1 to 4 bytes are counted")
    rows = labelled.select(F.col(f"`{lang_col}`").alias("lang"), text_of(labelled, text_col).alias("text"), F.xxhash64("*").alias("at"))
    rows = rows.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, max_docs / n)))])
    if not sizes:
        return LanguageModel([], order)
    sample = rows.where(F.pmod("at", F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).select("lang", "text")
    counted = sample.mapInArrow(_count_grams(order), "lang string, gram long, n long")
    counted = counted.groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    return LanguageModel.of_counts(counted.select("gram", "lang", "n").toArrow(), order, sizes)


def identify_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", max_bits: float = MAX_BITS) -> DataFrame:
    """(row, lang_pred, score, bits_per_byte, accepted): every row of ``docs`` as a struct, and its language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = text_of(docs, text_col)
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters")
    # A text that is a string already travels once, inside its row.
    inside = text_col in docs.columns and isinstance(docs.schema[text_col].dataType, T.StringType)
    place = docs.columns.index(text_col) if inside else None
    chosen = docs.select(whole_row(docs), letters, *([text.alias("text")] if place is None else []))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in (whole.slice(at, _PIECE) for whole in batches for at in range(0, whole.num_rows, _PIECE)):
            letters = batch.column(1).to_pylist()
            if model.languages:
                best, score, bits = model.predict(batch.column(2) if place is None else batch.column(0).flatten()[place])
            else:
                letters = [False] * len(letters)
                best, score, bits = letters, letters, letters
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([b if ok else UNKNOWN for b, ok in zip(best, letters)], pa.string()),
                    pa.array([s if ok else 0.0 for s, ok in zip(score, letters)], pa.float64()),
                    pa.array([b if ok else 0.0 for b, ok in zip(bits, letters)], pa.float64()),
                ],
                ["row", "lang_pred", "score", "bits_per_byte"],
            )

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]
    found = chosen.mapInArrow(predict, T.StructType([chosen.schema[ROW], *fields]))
    accepted = (F.col("lang_pred") != UNKNOWN) & (F.col("bits_per_byte") < max_bits)
    return found.withColumn("accepted", accepted)


def keep_known_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", max_bits: float = MAX_BITS) -> DataFrame:
    """``docs`` without texts that are in none of the model's languages."""
    return unpack(identify_languages(docs, model, text_col, max_bits).where("accepted"), docs)
