"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and their heads, hashed into a table of ``1 << SLOT_BITS``
slots; a text holds a slot or not. The score is the logistic of a bias, a weight per
slot, and for every pair of slots of the text the inner product of their factors over the
number of its slots, so that pairs can mean what neither term means alone.

The machine is fitted in one task on about ``max_docs`` labelled rows, on all of their
terms: none is chosen or dropped beforehand by what it tells alone. Sparse Adagrad in its
follow-the-regularised-leader form runs over small batches in a fixed order and touches the slots
of a batch only; gradients that do not add up move nothing. Sample and table bound the
model, which is broadcast; scoring reads every text in one pass without a shuffle.

Defined results: a null or empty text has no terms and gets the score of the
bias; without labelled rows, or with one label only, the bias is the share of
toxic rows, one row added to each label; a document labelled twice counts as
toxic if any label says so; null labels are left out; repeated rows get equal
scores; terms that no labelled row holds count nothing; empty tables give no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortflow.llm.rows import ROW, text_of, whole_row
from sortflow.llm.wordbytes import ALNUM_BYTES, Texts, find_words, span_hashes, text_slices

MAX_DOCS = 16_000
SLOT_BITS = 18
FACTORS = 8
EPOCHS = 6
BATCH = 128
RATE = 1.0
STEADY = 1.0
SPREAD = 0.1
#: A weight or factor stays where it started until its gradients sum up to more than this.
LEAST_WEIGHT, LEAST_FACTOR = 12.0, 1.0
HEADS = (3, 4, 5, 6)
SEED = 20


def _slots(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(slots, borders): text ``i`` holds the slots ``slots[borders[i]:borders[i + 1]]``, each once, ascending."""
    words = find_words(texts, ALNUM_BYTES)
    found = []
    for size in (None, *HEADS):
        longer = np.ones(len(words.row), bool) if size is None else words.end - words.start > size
        start, end, row = words.start[longer], words.end[longer], words.row[longer]
        h = span_hashes(texts, start, end if size is None else start + size)
        h = (h ^ np.uint64(0 if size is None else size)) >> np.uint64(64 - SLOT_BITS)
        found.append((row.astype(np.int64) << SLOT_BITS) | h.astype(np.int64))
    found = np.unique(np.concatenate(found))
    return found & ((1 << SLOT_BITS) - 1), np.searchsorted(found, np.arange(texts.rows + 1) << SLOT_BITS)


def _sums(values: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` from each border to the next; nothing sums to zero."""
    out = np.zeros((len(border) - 1, *values.shape[1:]))
    full = border[1:] > border[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, border[:-1][full], axis=0)
    return out


@dataclass
class FactorizationMachine:
    """Bias, and weights and factors of every slot."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, slots: np.ndarray, border: np.ndarray) -> np.ndarray:
        """Log-odds of texts, text ``i`` holding ``slots[border[i]:border[i + 1]]``."""
        v = self.factors[slots].astype(np.float64)
        pairs = (_sums(v, border) ** 2).sum(axis=1) - _sums((v * v).sum(axis=1), border)
        return self.bias + _sums(self.weights[slots], border) + 0.5 * pairs / np.maximum(np.diff(border), 1)

    def scores(self, texts: Texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(*_slots(texts)), -40, 40)))


def _batch(slots: np.ndarray, border: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and borders of the chosen texts alone."""
    lengths = border[chosen + 1] - border[chosen]
    own = np.concatenate([[0], np.cumsum(lengths)])
    return slots[np.arange(own[-1]) + np.repeat(border[chosen] - own[:-1], lengths)], own


def fit(
    slots: np.ndarray, border: np.ndarray, toxic: np.ndarray, epochs: int = EPOCHS, table: int = 1 << SLOT_BITS
) -> FactorizationMachine:
    """Fit on texts given as in :func:`_slots`."""
    n, n_toxic = len(toxic), int(toxic.sum())
    fm = FactorizationMachine(
        float(np.log((n_toxic + 1) / (n - n_toxic + 1))), np.zeros(table), np.zeros((table, FACTORS))
    )
    if not 0 < n_toxic < n:
        return fm
    chance = np.random.default_rng(SEED)
    held = np.zeros((table, 1), bool)
    held[slots] = True
    # Column 0 stands for the weight, the others for the factors, which start at random where a text holds the slot.
    start = np.column_stack([fm.weights, np.where(held, chance.normal(0, SPREAD, fm.factors.shape), 0.0)])
    now, pull, seen, seen_bias = start.copy(), np.zeros_like(start), np.zeros_like(start), 1.0
    least = np.array([LEAST_WEIGHT] + [LEAST_FACTOR] * FACTORS)
    for _ in range(epochs):
        order = chance.permutation(n)
        for begin in range(0, n, BATCH):
            chosen = order[begin : begin + BATCH]
            own, at = _batch(slots, border, chosen)
            size, row = np.maximum(np.diff(at), 1), np.repeat(np.arange(len(chosen)), np.diff(at))
            fm.weights, fm.factors = now[:, 0], now[:, 1:]
            error = 1 / (1 + np.exp(-np.clip(fm.margins(own, at), -40, 40))) - toxic[chosen]
            v = now[own, 1:]
            per_slot = np.column_stack([error[row], (error / size)[row, None] * (_sums(v, at)[row] - v)])
            by_slot = np.argsort(own, kind="stable")
            used, first = np.unique(own[by_slot], return_index=True)
            grads = _sums(per_slot[by_slot], np.append(first, len(own)))
            before = np.sqrt(seen[used])
            seen[used] += grads**2
            after = np.sqrt(seen[used])
            pull[used] += grads - (after - before) / RATE * (now[used] - start[used])
            strong = np.sign(pull[used]) * np.maximum(np.abs(pull[used]) - least, 0)
            now[used] = start[used] - strong * RATE / (STEADY + after)
            seen_bias += error.sum() ** 2
            fm.bias -= RATE * error.sum() / np.sqrt(seen_bias)
    fm.weights, fm.factors = now[:, 0], now[:, 1:]
    return fm


def _slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column(0).to_pylist()
        for texts in text_slices(batch.column(1)):
            slots, border = _slots(texts)
            held = [slots[border[i] : border[i + 1]].astype("<i4").tobytes() for i in range(texts.rows)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(toxic[texts.first : texts.first + texts.rows], pa.int32()), pa.array(held, pa.binary())],
                ["toxic", "slots"],
            )


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        rows += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
    rows.sort()
    slots = np.frombuffer(b"".join(held for _, held in rows), "<i4")
    border = np.concatenate([[0], np.cumsum([len(held) // 4 for _, held in rows])]).astype(np.int64)
    fm = fit(slots, border, np.array([toxic for toxic, _ in rows], np.float64))
    parts = [pa.array([x.astype("<f4").tobytes()], pa.binary()) for x in (fm.weights, fm.factors)]
    yield pa.RecordBatch.from_arrays([pa.array([fm.bias]), *parts], ["bias", "weights", "factors"])


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_docs: int = MAX_DOCS,
) -> FactorizationMachine:
    """Fit on about ``max_docs`` labelled documents, chosen by a hash of their id."""
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic"))
    marks = marks.where("id is not null and toxic is not null").groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    share = min(1.0, max_docs / max(1, marks.count()))
    chosen = F.broadcast(marks.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(docs, text_col).alias("text"))
    rows = texts.join(chosen, "id").select("toxic", "text").mapInArrow(_slot_rows, "toxic int, slots binary")
    fitted = rows.repartition(1).mapInArrow(_fit_rows, "bias double, weights binary, factors binary")
    models = fitted.collect()
    if not models:
        return fit(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0))
    weights, factors = (np.frombuffer(bytes(models[0][c]), "<f4") for c in ("weights", "factors"))
    return FactorizationMachine(models[0]["bias"], weights, factors.reshape(-1, FACTORS))


def score_toxicity(docs: DataFrame, model: FactorizationMachine, text_col: str = "text") -> DataFrame:
    """(row, score): every row of ``docs`` as a struct, and how likely its text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(whole_row(docs), text_of(docs, text_col).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.scores(texts) for texts in text_slices(batch.column(1))]
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [ROW, "score"])

    schema = chosen.select(ROW).schema.add("score", "double")
    return chosen.mapInArrow(score, schema)
