"""Substring deduplication by sliding spans of sentences.

A text is cut into sentences: after a word that ends in a full stop, question or
exclamation mark, at a line end, and, so that a passage is cut alike wherever it
was pasted in, after words chosen by their hash. With ``passage`` these are the
smallest of every window of words (winnowing), so narrow that any ``passage`` words
in a row hold a whole span, whatever stands around them; without it, words whose
hash is a multiple of ``CUT_EVERY``, which guarantees nothing. From each sentence a span runs over at least ``sentences`` sentences and ``words``
words. Equal spans are found by one aggregate over a 96-bit hash, with partial
counts before the shuffle; the first occurrence, by document and place, stays,
and every sentence that another occurrence covers is removed.

Texts without a repeat are not shuffled, as long as the ids of the others can be
broadcast. No group is gathered: a span keeps its first document only, and the occurrences
meet it in a join whose large keys Spark can split. What a text repeats itself is
found where the text is cut. Spans of a document are collected per document, whose
length bounds them.

Defined results: a null or empty text has no sentences and stays as it is;
documents are told apart by id, those with a null id by the hash of their text;
rows that repeat an id count as the same place: none removes the other, and what
is removed from one is removed from all; a text that repeats itself keeps its
first span; empty tables give no rows; other columns pass through in the row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortflow.llm.rows import ROW, text_of, whole_row
from sortflow.llm.wordbytes import SOLID_BYTES, Texts, Words, by_row, find_words, mix, span_hashes, text_slices, word_run_hashes
from sortflow.plans.workspace import materialise

SENTENCES = 3
WORDS = 12
CUT_EVERY = 4
#: Words of a passage that is found wherever it was pasted in.
PASSAGE = 51
#: Text worked on at once: a task takes about 100 times as much for hashes.
SLICE_BYTES = 1 << 20
#: Ids broadcast at most, 8 bytes each.
MAX_IDS = 1_000_000
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True
_SALT = np.uint64(0x5851F42D4C957F2D)


def window_of(passage: int, sentences: int = SENTENCES, words: int = WORDS) -> int:
    """The widest window whose cuts leave a whole span in any ``passage`` words.

    A cut depends on less than a window on either side. In what remains of the passage the first cut comes within a
    window, and the span ends within a window a sentence, or within a window from its last needed word.
    """
    w = 0
    while w + max(sentences * (w + 1), words + w) < passage - 2 * w:
        w += 1
    if not w:
        raise ValueError(f"No cuts leave {sentences} sentences and {words} words in every {passage} words")
    return w


def _smallest_of_windows(words: Words, hashes: np.ndarray, window: int) -> np.ndarray:
    """Whether a word has the smallest hash of some window of its row."""
    n = len(hashes)
    least = np.zeros(n, np.uint64)
    whole = n - window + 1
    if whole > 0:
        lowest = hashes[:whole].copy()
        for k in range(1, window):
            np.minimum(lowest, hashes[k : k + whole], out=lowest)
        least[:whole] = np.where(words.row[:whole] == words.row[window - 1 :], lowest, np.uint64(0))
    best = least.copy()
    for k in range(1, min(window, n)):
        np.maximum(best[k:], least[: n - k], out=best[k:])
    return best == hashes


def cut_sentences(texts: Texts, window: int | None = None) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, their hashes, and the first word of every sentence with the number of words at the end."""
    words = find_words(texts, SOLID_BYTES)
    hashes = span_hashes(texts, words.start, words.end)
    n = len(hashes)
    if not n:
        return words, hashes, np.zeros(1, np.int64)
    chosen = _smallest_of_windows(words, hashes, window) if window else hashes % np.uint64(CUT_EVERY) == 0
    ends = _ENDS[texts.data[words.end - 1]] | chosen
    line_ends = np.flatnonzero(texts.data == 10)
    after = np.searchsorted(line_ends, words.end)
    before_next = np.searchsorted(line_ends, np.append(words.start[1:], len(texts.data)))
    ends |= after < before_next
    ends[:-1] |= words.row[1:] != words.row[:-1]
    ends[-1] = True
    return words, hashes, np.concatenate([[0], np.flatnonzero(ends) + 1])


def spans_of(texts: Texts, sentences: int = SENTENCES, words: int = WORDS, window: int | None = None):
    """Sentences of the texts, and their spans.

    Returns (words, border, row, first, last, one, two, again): words and borders of :func:`cut_sentences`; of every
    span its row, first and last sentence over all rows, a 128-bit hash, and whether its row has it earlier on.
    """
    found, hashes, border = cut_sentences(texts, window)
    n = len(border) - 1
    row = found.row[border[:-1]] if n else np.zeros(0, np.int64)
    first = np.arange(n)
    last = np.maximum(first + sentences - 1, np.searchsorted(border, border[:-1] + words) - 1)
    inside = np.flatnonzero(last < n)
    inside = inside[row[inside] == row[last[inside]]]
    first, last, row = first[inside], last[inside], row[inside]
    one = word_run_hashes(hashes, border[first], border[last + 1])
    two = word_run_hashes(mix(hashes ^ _SALT), border[first], border[last + 1])
    order = np.lexsort((first, two, one, row))
    again = np.zeros(len(order), bool)
    same = [x[order[1:]] == x[order[:-1]] for x in (row, one, two)]
    again[order[1:]] = same[0] & same[1] & same[2]
    return found, border, row, first, last, one, two, again


def _first_sentences(found: Words, border: np.ndarray, rows: int) -> np.ndarray:
    """Borders of the rows among the sentences."""
    return by_row(found.row[border[:-1]] if len(border) > 1 else np.zeros(0, np.int64), rows)


def _spans(sentences: int, words: int, window: int | None):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            for texts in text_slices(batch.column(1), SLICE_BYTES):
                found, border, row, first, _, one, two, again = spans_of(texts, sentences, words, window)
                new = ~again
                number = first - _first_sentences(found, border, texts.rows)[row]
                half = (two >> np.uint64(32)).astype(np.uint32).view(np.int32)
                columns = [one.view(np.int64), half, docs[texts.first + row], number.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c[new]) for c in columns], ["one", "two", "doc", "first"])

    return cut


def _remove(sentences: int, words: int, window: int | None, text_col: str):
    """Drop the sentences of the spans in a document's list, and of those it repeats itself."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lists = batch.column(0), batch.column(1).to_pylist()
            column = rows.field(rows.type.get_field_index(text_col)).cast(pa.string())
            old, out, counts, removed, words_removed = column.to_pylist(), [], [], [], []
            for texts in text_slices(column, SLICE_BYTES):
                whole = next(text_slices(column.slice(texts.first, texts.rows), max_bytes=1 << 62, lower=False)).data
                found, border, row, first, last, _, _, again = spans_of(texts, sentences, words, window)
                per_row = _first_sentences(found, border, texts.rows)
                listed = [np.asarray(x or (), np.int64) for x in lists[texts.first : texts.first + texts.rows]]
                marked = np.zeros(len(border), bool)
                marked[first[again]] = True
                for i, x in enumerate(listed):
                    x = per_row[i] + x
                    marked[x[x < per_row[i + 1]]] = True
                gone = np.zeros(len(border) + 1, np.int64)
                chosen = marked[first]
                np.add.at(gone, first[chosen], 1)
                np.add.at(gone, last[chosen] + 1, -1)
                gone = np.cumsum(gone)[: len(border) - 1] > 0
                sizes = np.diff(border)
                begins = found.start[border[:-1]] if len(border) > 1 else border[:0]
                for i in range(texts.rows):
                    own = slice(per_row[i], per_row[i + 1])
                    counts.append(own.stop - own.start)
                    removed.append(int(gone[own].sum()))
                    words_removed.append(int(sizes[own][gone[own]].sum()))
                    if not removed[-1]:
                        out.append(old[texts.first + i])
                        continue
                    starts = np.append(begins[own], texts.offsets[i + 1])
                    starts[0] = texts.offsets[i]
                    kept = [whole[a:b].tobytes() for a, b, g in zip(starts[:-1], starts[1:], gone[own]) if not g]
                    out.append(b"".join(kept).decode("utf-8", "replace"))
            columns = [pa.array(x, pa.int64()) for x in (counts, removed, words_removed)]
            names = [ROW, "text", "n_sentences", "n_removed", "n_words_removed"]
            yield pa.RecordBatch.from_arrays([rows, pa.array(out, pa.string()), *columns], names)

    return remove


def remove_repeated_spans(
    docs: DataFrame,
    sentences: int = SENTENCES,
    words: int = WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    passage: int | None = None,
) -> DataFrame:
    """(row, text, n_sentences, n_removed, n_words_removed): every row as a struct, and its text without repeats."""
    window = window_of(passage, sentences, words) if passage else None
    text = text_of(docs, text_col)
    doc = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.xxhash64(text))
    rows = docs.select(whole_row(docs), text.alias("text"), doc.alias("doc"))
    cut = rows.select("doc", "text").mapInArrow(_spans(sentences, words, window), "one long, two int, doc long, first int")
    kept = cut.groupBy("one", "two").agg(F.min("doc").alias("kept"))
    again = cut.join(kept, ["one", "two"]).where("doc != kept")
    by_doc = materialise(again.groupBy("doc").agg(F.collect_set("first").alias("spans")), "repeated-spans")
    rows = rows.drop("text")
    if by_doc.count() <= MAX_IDS:
        ids = F.broadcast(by_doc.select("doc"))
        untouched = rows.join(ids, "doc", "left_anti").withColumn("spans", F.lit(None).cast("array<int>"))
        marked = rows.join(ids, "doc", "left_semi").join(by_doc, "doc").unionByName(untouched).select(ROW, "spans")
    else:
        marked = rows.join(by_doc, "doc", "left").select(ROW, "spans")
    schema = marked.select(ROW).schema.add("text", "string").add("n_sentences", "long").add("n_removed", "long")
    return marked.mapInArrow(_remove(sentences, words, window, text_col), schema.add("n_words_removed", "long"))
