"""The fitted features of texts: one pass from text columns to one sparse vector.

Spark cuts words and blanks, by the expressions the vocabularies were counted with;
a task counts the kept terms of some hundred texts at once and makes no term that
is not kept. Words and pairs are looked up by number. Character grams are found by
a tree over the kept grams: one table lookup takes all characters of the texts one
letter further, whatever their number of terms.

Defined results: a null or empty text has no terms, its part of the vector is 0;
values are count times idf, scaled to length 1 in each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortflow.functions.ngrams import blank_separated, word_tokens

#: Rows that are counted at once, and characters: memory does not grow with the batch or with a text.
_PIECE, _CHARS = 500, 1 << 20
#: Entries of a tree's table; larger alphabets are searched.
_TABLE = 1 << 22
_VECTOR = pa.struct(
    [("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))]
)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted ``keys``, whether it is there) of every number ``wanted``."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


class _WordTerms:
    """Kept words and pairs of neighbouring words."""

    def __init__(self, terms: list[str]) -> None:
        self.width = len(terms)
        words = sorted({w for term in terms for w in term.split(" ")})
        number = {w: i for i, w in enumerate(words)}
        self.words, self.single = words, np.full(len(words), -1)
        pairs = []
        for i, term in enumerate(terms):
            first, *second = term.split(" ")
            if second:
                pairs.append((number[first] * len(words) + number[second[0]], i))
            else:
                self.single[number[first]] = i
        self.pairs, self.pair_terms = np.array(sorted(pairs), np.int64).reshape(-1, 2).T.copy()

    def hits(self, column: pa.Array) -> Iterator[np.ndarray]:
        """row * width + term of every occurrence in a column of word lists."""
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(column)), lengths)
        values = column.flatten()
        known = pc.index_in(values, value_set=pa.array(self.words, values.type))
        word = pc.fill_null(known, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        term = np.where(word >= 0, self.single[word], -1)
        yield row[term >= 0] * self.width + term[term >= 0]
        first = np.flatnonzero((word[:-1] >= 0) & (word[1:] >= 0) & (row[:-1] == row[1:]))
        at, there = _found(self.pairs, word[first] * len(self.words) + word[first + 1])
        yield row[first[there]] * self.width + self.pair_terms[at[there]]


class _GramTerms:
    """Kept character n-grams of padded words, as a tree: node 0 is none, node 1 the empty gram.

    Two blanks stand between padded words, and in no kept gram, so no gram is
    found across words, and one shorter than n only where it is a whole word.
    """

    def __init__(self, terms: list[str]) -> None:
        self.width, self.sizes = len(terms), set(map(len, terms))
        self.deep = max(self.sizes, default=0)
        letters = sorted({ord(c) for term in terms for c in term})
        self.rank = np.zeros(0x110000, np.int32)
        self.rank[letters] = np.arange(1, len(letters) + 1)
        self.letters = len(letters) + 1
        children: dict[int, int] = {}
        ends = {}
        for i, term in enumerate(terms):
            node = 1
            for letter in self.rank[list(map(ord, term))].tolist():
                node = children.setdefault(node * self.letters + letter, len(children) + 2)
            ends[node] = i
        nodes = len(children) + 2
        self.term = np.full(nodes, -1)
        self.term[list(ends)] = list(ends.values())
        self.keys, self.next = np.array(sorted(children.items()), np.int64).reshape(-1, 2).T.copy()
        self.table = None
        if nodes * self.letters <= _TABLE:
            self.table = np.zeros(nodes * self.letters, np.int32)
            self.table[self.keys] = self.next

    def _step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[node * np.int32(self.letters) + letter]
        at, there = _found(self.keys, node * np.int64(self.letters) + letter)
        return np.where(there, self.next[at], 0)

    def hits(self, column: pa.Array) -> Iterator[np.ndarray]:
        """row * width + term of every occurrence in a column of texts, whose words are parted by one blank."""
        for at, texts in _runs(column.to_pylist()):
            padded = [f" {text.replace(' ', '  ')} " if text else "" for text in texts]
            first = np.repeat(np.arange(at, at + len(texts)) * self.width, [len(text) for text in padded])
            letters = self.rank[np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32)]
            letters = np.append(letters, np.zeros(self.deep, np.int32))
            for begin in range(0, len(first), _CHARS):
                end = min(begin + _CHARS, len(first))
                node = np.ones(end - begin, np.int32)
                for depth in range(self.deep):
                    node = self._step(node, letters[begin + depth : end + depth])
                    if depth + 1 in self.sizes:
                        term = self.term[node]
                        kept = term >= 0
                        yield first[begin:end][kept] + term[kept]


def _runs(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """(place of the first, texts) of runs of at most ``_CHARS`` characters, or of one text with more."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > _CHARS:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(text or "")
    yield at, texts[at:]


def _counts(hits: Iterator[np.ndarray], size: int) -> np.ndarray:
    """How often each number below ``size`` comes."""
    counts, held, n = np.zeros(size, np.int64), [], 0
    for keys in hits:
        held.append(keys)
        n += len(keys)
        if n > 4 * _CHARS:
            counts += np.bincount(np.concatenate(held), minlength=size)
            held, n = [], 0
    return counts + np.bincount(np.concatenate(held), minlength=size) if n else counts


class _Counter:
    """Sparse vectors of the kept terms of all blocks."""

    def __init__(self, vocabularies: list[dict]) -> None:
        self.blocks = [
            ((_WordTerms if v["analyzer"] == "word" else _GramTerms)(v["terms"]), np.array(v["idf"], np.float64))
            for v in vocabularies
        ]
        self.size = sum(len(idf) for _, idf in self.blocks)

    def vectors(self, columns: list[pa.Array]) -> pa.Array:
        rows, parts, offset = len(columns[0]), [], 0
        for (block, idf), column in zip(self.blocks, columns):
            counts = _counts(block.hits(column) if block.width else iter(()), rows * block.width)
            used = np.flatnonzero(counts)
            row, term = np.divmod(used, max(block.width, 1))
            weight = counts[used] * idf[term]
            norm = np.sqrt(np.bincount(row, weight * weight, minlength=rows))
            parts.append((row, term + offset, weight / norm[row]))
            offset += block.width
        row, term, weight = (np.concatenate(part) for part in zip(*parts))
        order = np.argsort(row, kind="stable")
        borders = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=rows))).astype(np.int32))
        indices = pa.ListArray.from_arrays(borders, pa.array(term[order].astype(np.int32)))
        values = pa.ListArray.from_arrays(borders, pa.array(weight[order]))
        kind, size = pa.array(np.zeros(rows, np.int8)), pa.array(np.full(rows, self.size, np.int32))
        return pa.StructArray.from_arrays([kind, size, indices, values], fields=list(_VECTOR))


class TextVectors(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``features``, one sparse vector per row, from the text columns of the blocks.

    ``vocabularies``: per block its column, analyzer, kept terms and their idf.
    """

    vocabularies = Param(Params._dummy(), "vocabularies", "column, analyzer, terms and idf of each block")

    def __init__(self, vocabularies: list[dict] | None = None) -> None:
        super().__init__()
        if vocabularies is not None:
            self.set(self.vocabularies, vocabularies)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        blocks = self.getOrDefault(self.vocabularies)
        shared = dataset.sparkSession.sparkContext.broadcast(_Counter(blocks))

        @F.arrow_udf(VectorUDT())
        def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            counter = shared.value
            for batch in batches:
                columns = batch.flatten()
                pieces = [
                    counter.vectors([c.slice(at, _PIECE) for c in columns]) for at in range(0, len(batch), _PIECE)
                ]
                yield pa.concat_arrays(pieces) if pieces else pa.array([], _VECTOR)

        cut = [F.expr((word_tokens if b["analyzer"] == "word" else blank_separated)(f"`{b['column']}`")) for b in blocks]
        texts = F.struct(*[c.alias(f"block_{i}") for i, c in enumerate(cut)])
        return dataset.withColumn("features", vectors(texts))
