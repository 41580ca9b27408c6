"""Packing: documents routed to context-size tiers, tiers packed into full windows, gaps filled from shorter tiers.

A document is its token ids and an end id. A part longer than the longest window
is cut into full windows and a rest; a rest belongs to the shortest tier that
holds it. Windows are opened for the longest parts first, in the window size of
their tier; the gap is filled with the longest shorter part that fits, again
and again, and what remains with the head of the shortest part at hand, whose
tail goes back into its tier. So every window is full, but the last of a task.

Packing runs inside the tasks that tokenise, in blocks of bounded size: ids
never cross the network, but for the one window a task could not fill. Those are
packed together, 256 tasks to one, and only the last of these are padded. A
tier's windows are dealt evenly to step groups, so that every step trains on the
same mixture of lengths and of tokens.

Defined results: a null or empty text is the end id alone; repeated rows are
packed as often as they come; a null id is kept as null; an empty table gives no
rows; columns other than id and text are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sortflow.llm.wordbytes import Texts, Words, find_words, lower_case, mix, runs_of_rows, text_slices, word_hashes
from sortflow.plans.broadcasting import checked_broadcast
from sortflow.plans.workspace import materialise

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
#: Tokens packed at once: a block holds them as 4-byte ids.
BLOCK_TOKENS = 4_000_000
#: Words whose ids a Python worker remembers: about 50 bytes each.
MAX_WORDS = 1_500_000
#: Text after which a block is looked at, and text tokenised at once, as its words and ids take many times as much.
SLICE_BYTES, PIECE_BYTES = 4 << 20, 1 << 20
#: New words handed to the tokenizer at once: it takes many times their bytes.
LEARN_WORDS = 10_000
_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 13, 32]] = False
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(97, 123)]] = True
_STOPS = np.zeros(256, bool)
_STOPS[list(b".,;:!?")] = True
#: Tasks whose unfilled windows are packed together.
FAN_IN = 256
#: Tokens of one training step.
STEP_TOKENS = 1 << 20

_PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("tier", T.IntegerType()),
        T.StructField("task", T.LongType()),
        T.StructField("nth", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)
_ARROW = pa.schema(
    [(f, pa.int64()) for f in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    + [("tier", pa.int32()), ("task", pa.int64()), ("nth", pa.int64()), ("ids", pa.binary())]
)


class Tokeniser:
    """Ids of many texts at once: every distinct word is tokenised once and its ids are gathered.

    For vocabularies in which white space and a stop after a letter or digit are
    borders of words, and in which A-Z count as lower case. Words are told apart
    by a 64-bit hash. At most ``MAX_WORDS`` words are remembered, over all tasks
    of a Python worker; beyond that it starts anew. Strings of added tokens are
    cut out of the text as it is written, before it is lower-cased, and get their id.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        # What is learnt are words between added tokens: there their strings are ordinary text.
        self.model.encode_special_tokens = True
        added = self.model.get_added_tokens_decoder()
        self.added = {t.content.encode(): i for i, t in added.items()}
        for raw, token in zip(self.added, added.values()):
            plain = np.frombuffer(raw, np.uint8)
            if token.normalized or token.lstrip or token.rstrip or token.single_word or _STOPS[plain].any() or not _SOLID[plain].all():
                raise ValueError(f"An added token that is no word of its own: {token.content}")
        longest_first = sorted(self.added, key=len, reverse=True)
        self.added_pattern = re.compile(b"|".join(map(re.escape, longest_first))) if self.added else None
        self.added_hashes = {i: mix(np.array([i], np.uint64) + np.uint64(1 << 63))[0] for i in self.added.values()}
        self._forget()

    def _forget(self) -> None:
        known = sorted((h, i) for i, h in self.added_hashes.items())
        self.hashes = np.array([h for h, _ in known], np.uint64)
        self.begins = np.arange(len(known))
        self.sizes = np.ones(len(known), np.int64)
        self.flat = np.array([i for _, i in known], np.uint32)

    def _added(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id) of the strings of added tokens, from the left; none crosses a row."""
        found = []
        if self.added_pattern is not None:
            raw = texts.data.tobytes()
            if self.added_pattern.search(raw):
                for a, b in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist()):
                    found += [(m.start(), m.end(), self.added[m[0]]) for m in self.added_pattern.finditer(raw, a, b)]
        return tuple(np.array(found, np.int64).reshape(-1, 3).T)

    @staticmethod
    def _pieces(texts: Texts, borders: np.ndarray) -> Words:
        """Words between white space, cut before stops that follow a letter or digit, and at ``borders``."""
        data = texts.data
        cuts = np.zeros(len(data), bool)
        if len(data) > 2:
            cuts[1:] = _PLAIN[data[:-1]]
            cuts[2:] |= (data[:-2] == 0xC3) & (data[1:-1] >= 0x80) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
            cuts &= _STOPS[data]
        cuts[borders[borders < len(data)]] = True
        return find_words(texts, _SOLID, cuts)

    def _encode(self, said: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        encoded = self.model.encode("\n".join(said), add_special_tokens=False)
        lengths = np.fromiter(map(len, said), np.int64, len(said))
        starts = np.cumsum(lengths + 1) - lengths - 1
        ids = np.array(encoded.ids, np.uint32)
        places = np.fromiter((o[0] for o in encoded.offsets), np.int64, len(ids))
        word = np.searchsorted(starts, places, side="right") - 1
        return ids, np.bincount(word, minlength=len(said))

    def _learn(self, hashes: np.ndarray, spans: list[tuple[int, int]], data: np.ndarray) -> None:
        """Remember the words at ``spans`` of ``data``, whose sorted hashes are ``hashes``."""
        raw = memoryview(data)
        said = ([str(raw[a:b], "utf-8") for a, b in spans[i : i + LEARN_WORDS]] for i in range(0, len(spans), LEARN_WORDS))
        ids, sizes = (np.concatenate(part) for part in zip(*map(self._encode, said)))
        begins = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, ids])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.begins = np.insert(self.begins, at, begins)
        self.sizes = np.insert(self.sizes, at, sizes)

    def __call__(self, texts: Texts, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(ids, borders): text ``i`` has ``ids[borders[i]:borders[i + 1]]``, its end id last. Texts as they are written."""
        starts, ends, added = self._added(texts)
        texts = lower_case(texts)
        words = self._pieces(texts, np.concatenate([starts, ends]))
        of_words = word_hashes(texts, words)
        of_words[np.searchsorted(words.start, starts)] = [self.added_hashes[i] for i in added.tolist()]
        hashes, first, code = np.unique(of_words, return_index=True, return_inverse=True)
        if len(self.hashes) > MAX_WORDS:
            self._forget()
        at = np.searchsorted(self.hashes, hashes)
        new = np.flatnonzero(at == len(self.hashes)) if not len(self.hashes) else np.flatnonzero(
            self.hashes[np.minimum(at, len(self.hashes) - 1)] != hashes
        )
        if len(new):
            spans = list(zip(words.start[first[new]].tolist(), words.end[first[new]].tolist()))
            self._learn(hashes[new], spans, texts.data)
            at = np.searchsorted(self.hashes, hashes)
        begin, size = self.begins[at][code], self.sizes[at][code]
        ends = np.cumsum(size)
        counts = np.bincount(words.row, weights=size, minlength=texts.rows).astype(np.int64) + 1
        borders = np.concatenate([[0], np.cumsum(counts)])
        ids = np.full(borders[-1], end_id, np.uint32)
        source = np.arange(int(ends[-1]) if len(ends) else 0)
        target = np.ones(len(ids), bool)
        target[borders[1:] - 1] = False
        ids[target] = self.flat[source + np.repeat(begin - (ends - size), size)]
        return ids, borders


_tokenisers: dict[str, Tokeniser] = {}


def tokeniser(path: str) -> Tokeniser:
    """One per Python worker, so that what it has learnt serves later tasks."""
    if path not in _tokenisers:
        _tokenisers[path] = Tokeniser(path)
    return _tokenisers[path]


class Packer:
    """Windows of one task. ``add`` collects parts; ``full`` yields the windows that are complete."""

    def __init__(self, tiers: tuple[int, ...]) -> None:
        self.tiers = tuple(sorted(tiers))
        self.parts: dict[int, list] = {}
        self.mask = 0
        self.tokens = 0

    def add(self, doc: tuple, start: int, ids: np.ndarray) -> None:
        """``doc`` identifies a document; ``ids`` are its ids from ``start`` on, at most one longest window."""
        n = len(ids)
        self.parts.setdefault(n, []).append((doc, start, ids))
        self.mask |= 1 << n
        self.tokens += n

    def _pop(self, n: int) -> tuple:
        parts = self.parts[n]
        part = parts.pop()
        if not parts:
            del self.parts[n]
            self.mask ^= 1 << n
        self.tokens -= n
        return part

    def full(self, last: bool) -> Iterator[tuple[int, list]]:
        """(tier, parts) of full windows; ``last`` also yields the final one, which may have a gap."""
        while self.mask:
            if not last and self.tokens < self.tiers[-1]:
                return
            longest = self.mask.bit_length() - 1
            tier = self.tiers[bisect_left(self.tiers, longest)]
            if self.tokens < tier and not last:
                return
            window, gap = [self._pop(longest)], tier - longest
            while gap and self.mask:
                fits = self.mask & ((1 << (gap + 1)) - 1)
                if fits:
                    n = fits.bit_length() - 1
                    window.append(self._pop(n))
                    gap -= n
                else:
                    shortest = (self.mask & -self.mask).bit_length() - 1
                    doc, start, ids = self._pop(shortest)
                    window.append((doc, start, ids[:gap]))
                    self.add(doc, start + gap, ids[gap:])
                    gap = 0
            yield tier, window


class _Writer:
    """Rows of pieces for the windows of one task."""

    def __init__(self, task: int) -> None:
        self.task = task
        self.sequence = 0
        self.nth: dict[int, int] = {}
        self.columns: list[list] = [[] for _ in _ARROW]

    def window(self, tier: int, parts: list, keep_ids: bool) -> None:
        nth = self.nth.get(tier, 0)
        self.nth[tier] = nth + 1
        offset = 0
        for (doc_id, doc_tokens), start, ids in parts:
            raw = ids.astype("<u4").tobytes()
            row = (doc_id, start, len(ids), zlib.crc32(raw), doc_tokens, (self.task << 32) + self.sequence, offset)
            for column, value in zip(self.columns, (*row, tier, self.task, nth, raw if keep_ids else None)):
                column.append(value)
            offset += len(ids)
        self.sequence += 1

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, _ARROW)], schema=_ARROW)
        self.columns = [[] for _ in _ARROW]
        return out


def _pack_texts(tokenizer_path: str, tiers: tuple[int, ...], end_id: int, block_tokens: int):
    longest = max(tiers)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenise, packer = tokeniser(tokenizer_path), Packer(tiers)
        writer = _Writer(TaskContext.get().partitionId())
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for whole in text_slices(batch.column(1), SLICE_BYTES, lower=False):
                for texts in runs_of_rows(whole, PIECE_BYTES):
                    ids, borders = tokenise(texts, end_id)
                    for i, doc_id in enumerate(doc_ids[texts.first : texts.first + texts.rows]):
                        own = ids[borders[i] : borders[i + 1]]
                        doc = (doc_id, len(own))
                        for start in range(0, len(own), longest):
                            packer.add(doc, start, own[start : start + longest])
                if packer.tokens >= block_tokens:
                    for tier, parts in packer.full(last=False):
                        writer.window(tier, parts, keep_ids=False)
                    yield writer.batch()
        for tier, parts in packer.full(last=True):
            writer.window(tier, parts, keep_ids=sum(len(p[2]) for p in parts) < tier)
        yield writer.batch()

    return pack


def _pack_rests(tiers: tuple[int, ...], base: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, writer = Packer(tiers), _Writer(base + TaskContext.get().partitionId())
        for batch in batches:
            for row in batch.select(["doc_id", "start", "doc_tokens", "ids"]).to_pylist():
                ids = np.frombuffer(row["ids"], "<u4")
                packer.add((row["doc_id"], row["doc_tokens"]), row["start"], ids)
        for tier, parts in packer.full(last=True):
            writer.window(tier, parts, keep_ids=False)
        yield writer.batch()

    return pack


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = END_ID,
    step_tokens: int = STEP_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per piece: its document, place in the document, window, place in the window, tier, and step group.

    The tokenizer has to treat white space as a border of words and drop it;
    ``tokenizer_path`` must exist on every executor.
    """
    spark = docs.sparkSession
    chosen = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")
    )
    packed = materialise(chosen.mapInArrow(_pack_texts(tokenizer_path, tiers, end_id, block_tokens), _PIECES), "packing")
    done, rests = packed.where("ids is null"), packed.where("ids is not null")
    tasks = rests.agg(F.max("task"), F.count_distinct("task")).first()
    if tasks[0] is not None:
        few = rests.repartition(-(-tasks[1] // FAN_IN))
        rests = materialise(few.mapInArrow(_pack_rests(tiers, (1 << 30)), _PIECES), "packing-rests")
    pieces = done.drop("ids").unionByName(rests.drop("ids"))

    counts = pieces.groupBy("tier", "task").agg((F.max("nth") + 1).alias("windows"))
    before = W.partitionBy("tier").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    places = counts.select(
        "tier",
        "task",
        F.coalesce(F.sum("windows").over(before), F.lit(0)).alias("first"),
        F.sum("windows").over(W.partitionBy("tier")).alias("in_tier"),
    )
    tokens = counts.agg(F.sum(F.col("windows") * F.col("tier"))).first()[0] or 0
    placed = pieces.join(checked_broadcast(places), ["tier", "task"])
    group = F.floor((F.col("first") + F.col("nth")) * F.lit(-(-tokens // step_tokens)) / F.col("in_tier"))
    return placed.select(*[f.name for f in _PIECES.fields[:8]], group.cast("long").alias("step_group"))
