"""Benchmark decontamination: a broadcast set of benchmark word windows against every training text.

Words are runs of ASCII letters and digits and of anything outside ASCII, with
A-Z in lower case. A window is ``window`` consecutive words of a benchmark item;
an item with fewer words, but at least one, is one window of its own length.
A document word is hit if it lies inside an occurrence of any window.

The windows are written once, hashed and broadcast in blocks of about ``MAX_WINDOWS``, dealt
by window and item; a larger benchmark takes one more pass over the rows for each further
block, so that what is broadcast never grows with the benchmark. Equal hashes are
verified word by word.

Defined results: a null or empty text has no words and no hits; an item without
words hits nothing; items with equal texts are all listed; an item with a null
id hits words but is not listed; repeated rows give repeated results; empty
tables give no rows, an empty benchmark hits nothing; other columns of either
table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sortflow.llm.rows import ROW, text_of, unpack, whole_row
from sortflow.llm.wordbytes import ALNUM_BYTES, by_row, find_words, run_hashes, span_hashes, text_slices
from sortflow.plans.workspace import materialise

WINDOW = 10
#: Windows broadcast at once: about 100 bytes each.
MAX_WINDOWS = 200_000
_FILTER_BITS = 22

_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_words", T.ArrayType(T.IntegerType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, hash, length, words): the distinct windows of each item; ``words`` is joined by single spaces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for texts in text_slices(batch.column(1)):
                words = find_words(texts, ALNUM_BYTES)
                hashes = span_hashes(texts, words.start, words.end)
                borders = by_row(words.row, texts.rows)
                raw = texts.data.tobytes()
                out = []
                for length in range(1, window + 1):
                    first, runs = run_hashes(words, hashes, length)
                    for i, h in zip(first.tolist(), runs.view(np.int64).tolist()):
                        row = words.row[i]
                        if length == min(window, borders[row + 1] - borders[row]):
                            said = b" ".join(raw[words.start[k] : words.end[k]] for k in range(i, i + length))
                            out.append((ids[texts.first + row], h, length, said))
                columns = zip(*dict.fromkeys(out)) if out else ((), (), (), ())
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["item", "hash", "length", "words"]
                )

    chosen = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), text_of(benchmark, text_col).alias("text"))
    return chosen.mapInArrow(cut, "item string, hash long, length int, words binary").distinct()


class WindowIndex:
    """A block of benchmark windows, ready to be looked up from numpy arrays of hashes."""

    def __init__(self, rows: list) -> None:
        self.said: dict[int, dict[int, dict[bytes, set]]] = {}
        for row in rows:
            items = self.said.setdefault(row["length"], {}).setdefault(row["hash"], {}).setdefault(bytes(row["words"]), set())
            if row["item"] is not None:
                items.add(row["item"])
        self.seen = {}
        for length, known in self.said.items():
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[self._slot(np.fromiter(known, np.int64, len(known)).view(np.uint64))] = True
            self.seen[length] = seen

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def scan(self, column: pa.Array) -> tuple[list[int], list[list[int]], list[list[str]]]:
        """Per row: number of words, positions of hit words, items found."""
        n_words, hit_words, items = [], [], []
        for texts in text_slices(column):
            words = find_words(texts, ALNUM_BYTES)
            hashes = span_hashes(texts, words.start, words.end)
            borders = by_row(words.row, texts.rows)
            hit = np.zeros(len(words.row), bool)
            found: dict[int, set] = {}
            for length, known in self.said.items():
                first, runs = run_hashes(words, hashes, length)
                likely = np.flatnonzero(self.seen[length][self._slot(runs)])
                for i, h in zip(first[likely].tolist(), runs[likely].view(np.int64).tolist()):
                    if h in known:
                        said = b" ".join(
                            texts.data[words.start[k] : words.end[k]].tobytes() for k in range(i, i + length)
                        )
                        if said in known[h]:
                            hit[i : i + length] = True
                            found.setdefault(int(words.row[i]), set()).update(known[h][said])
            n_words += np.diff(borders).tolist()
            hit_at = np.flatnonzero(hit)
            hit_borders = by_row(words.row[hit_at], texts.rows)
            for i in range(texts.rows):
                hit_words.append((hit_at[hit_borders[i] : hit_borders[i + 1]] - borders[i]).tolist())
                items.append(sorted(found.get(i, ())))
        return n_words, hit_words, items


def find_benchmark_words(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text_col: str = "text",
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """(row, n_words, hit_words, items): every row of ``docs`` as a struct, and what was found in its text."""
    spark = docs.sparkSession
    windows = materialise(benchmark_windows(benchmark, window), "benchmark-windows")
    blocks = max(1, -(-windows.count() // max_windows))
    out = docs.select(
        whole_row(docs),
        text_of(docs, text_col).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<int>").alias("hit_words"),
        F.array().cast("array<string>").alias("items"),
    )
    for block in range(blocks):
        # Dealt by window and item: a window that very many items share is spread over all blocks.
        dealt = F.pmod(F.xxhash64("item", "length", "words"), F.lit(blocks))
        part = windows.where(dealt == block) if blocks > 1 else windows
        index = spark.sparkContext.broadcast(WindowIndex(part.collect()))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_words, hit_words, items = index.value.scan(batch.column(1))
                before = batch.column(3).to_pylist(), batch.column(4).to_pylist()
                hit_words = [sorted({*a, *b}) if a else b for a, b in zip(before[0], hit_words)]
                items = [sorted({*a, *b}) if a else b for a, b in zip(before[1], items)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[:2],
                        pa.array(n_words, pa.int64()),
                        pa.array(hit_words, pa.list_(pa.int32())),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    names=batch.schema.names,
                )

        schema = T.StructType([out.schema[ROW], out.schema["text"], *_FOUND.fields])
        out = out.mapInArrow(scan, schema)
    return out


def _without(column: pa.Array, hit_words: list[list[int]]) -> list[str]:
    """Texts without the runs of hit words, from a run's first byte to its last."""
    out = []
    for texts in text_slices(column):
        whole = next(text_slices(column.slice(texts.first, texts.rows), max_bytes=1 << 62, lower=False)).data
        words = find_words(texts, ALNUM_BYTES)
        borders = by_row(words.row, texts.rows)
        for i in range(texts.rows):
            keep, at = [], texts.offsets[i]
            hits = np.asarray(hit_words[texts.first + i], np.int64)
            if len(hits):
                cut = np.flatnonzero(np.diff(hits) > 1)
                for a, b in zip(np.r_[hits[0], hits[cut + 1]], np.r_[hits[cut], hits[-1]]):
                    keep.append(whole[at : words.start[borders[i] + a]].tobytes())
                    at = words.end[borders[i] + b]
            keep.append(whole[at : texts.offsets[i + 1]].tobytes())
            out.append(b"".join(keep).decode("utf-8", "replace"))
    return out


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    remove: str = "documents",
    window: int = WINDOW,
    text_col: str = "text",
) -> DataFrame:
    """``docs`` without its contaminated documents, or (``remove="spans"``) without the words that are hit."""
    if remove not in {"documents", "spans"}:
        raise ValueError(f"Cannot remove {remove!r}")
    found = find_benchmark_words(docs, benchmark, window, text_col)
    if remove == "documents":
        return unpack(found.where(F.size("hit_words") == 0), docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(3).to_pylist()
            texts = _without(batch.column(1), hits) if any(hits) else batch.column(1).to_pylist()
            texts = [new if hit else old for new, hit, old in zip(texts, hits, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    schema = T.StructType([found.schema[ROW], T.StructField("text", T.StringType())])
    kept = found.mapInArrow(cut, schema)
    return kept.select(*[(F.col("text") if c == text_col else F.col(ROW)[c]).alias(c) for c in docs.columns])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: word counts, the items found, and their digest."""
    found = find_benchmark_words(docs, benchmark, window, text_col)
    items = F.array_sort("items")
    return found.select(
        F.col(ROW)[id_col].alias("doc_id"),
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
        items.alias("items"),
    )
