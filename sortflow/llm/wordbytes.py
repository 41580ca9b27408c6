"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

Texts stay UTF-8 bytes: a batch is cut into slices of about a megabyte, words are
runs of wanted bytes, and a word or a run of words gets a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BYTE_STEP = 0x9E3779B97F4A7C15
_WORD_STEP = 0xD1342543DE82EF95
_power_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes of a word of letters, digits and everything outside ASCII, after lower-casing.
ALNUM_BYTES = np.zeros(256, bool)
ALNUM_BYTES[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: Bytes of a word between white space.
SOLID_BYTES = np.ones(256, bool)
SOLID_BYTES[[32, *range(9, 14)]] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Texts:
    """Lower-cased (A-Z) bytes of a run of rows; row ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


@dataclass(frozen=True)
class Words:
    """Words in text order: their row, first and past-the-end byte."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES, lower: bool = True) -> Iterator[Texts]:
    """Cut a text column into runs of whole rows of about ``max_bytes``. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    for texts in runs_of_rows(Texts(0, bytes_, offsets), max_bytes):
        yield lower_case(texts) if lower else texts


def runs_of_rows(texts: Texts, max_bytes: int) -> Iterator[Texts]:
    """Cut texts into runs of whole rows of about ``max_bytes``, as views."""
    at, offsets = 0, texts.offsets
    while at < texts.rows:
        stop = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
        stop = min(texts.rows, max(at + 1, stop))
        yield Texts(texts.first + at, texts.data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at])
        at = stop


def lower_case(texts: Texts) -> Texts:
    return Texts(texts.first, _LOWER[texts.data], texts.offsets)


def find_words(texts: Texts, inside: np.ndarray, cuts: np.ndarray | None = None) -> Words:
    """Longest runs of bytes for which ``inside`` holds; no word crosses a row, nor a byte marked in ``cuts``."""
    mask = inside[texts.data]
    border = np.zeros(len(mask) + 1, bool)
    if cuts is not None:
        border[:-1] = cuts
    border[texts.offsets] = True
    opens, closes = mask.copy(), mask.copy()
    opens[1:] &= ~mask[:-1] | border[1:-1]
    closes[:-1] &= ~mask[1:] | border[1:-1]
    start = np.flatnonzero(opens)
    counts = np.diff(np.searchsorted(start, texts.offsets))
    return Words(np.repeat(np.arange(texts.rows), counts), start, np.flatnonzero(closes) + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    known = _power_tables.get(step)
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(step, -1, 1 << 64)
        factors = np.ones((2, size + 1), np.uint64)
        factors[0, 1:], factors[1, 1:] = step, inverse
        known = tuple(np.cumprod(factors, axis=1, dtype=np.uint64))
        _power_tables[step] = known
    return known


def _prefix(values: np.ndarray, step: int) -> np.ndarray:
    forward, _ = _powers(step, len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * forward[: len(values)], dtype=np.uint64, out=sums[1:])
    return sums


def span_hashes(texts: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span; equal bytes have equal hashes wherever they stand."""
    sums = _prefix(texts.data.astype(np.uint64) + np.uint64(1), _BYTE_STEP)
    _, back = _powers(_BYTE_STEP, len(texts.data) + 1)
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def word_hashes(texts: Texts, words: Words, max_bytes: int = 1 << 18) -> np.ndarray:
    """:func:`span_hashes` of the words, those within ``max_bytes`` at a time: it takes memory for these alone."""
    found, at = np.empty(len(words.start), np.uint64), 0
    while at < len(found):
        begin = words.start[at]
        stop = max(at + 1, int(np.searchsorted(words.end, begin + max_bytes, side="right")))
        part = Texts(0, texts.data[begin : words.end[stop - 1]], texts.offsets[:0])
        found[at:stop] = span_hashes(part, words.start[at:stop] - begin, words.end[at:stop] - begin)
        at = stop
    return found


def run_hashes(words: Words, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of ``length`` consecutive words of one row."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(words.row[:n] == words.row[length - 1 :])
    return first, word_run_hashes(hashes, first, first + length)


def word_run_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the runs of words ``start`` to ``end``, from the hashes of the words."""
    sums = _prefix(hashes, _WORD_STEP)
    _, back = _powers(_WORD_STEP, len(hashes) + 1)
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def by_row(row: np.ndarray, rows: int) -> np.ndarray:
    """Borders of the rows in a sorted row column: row ``i`` is ``borders[i]:borders[i + 1]``."""
    return np.searchsorted(row, np.arange(rows + 1))
