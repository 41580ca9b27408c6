"""Alignment of two tokenizers over a corpus: which tokens end together, and how often which pair does.

A text is encoded by a byte-level BPE (A) and a sentence-piece model (B). Where a
token of A and one of B end at the same byte, the text is cut: the tokens between
two cuts are a group, and the two tokens at a cut are linked. How often a pair of
ids is linked in the whole corpus says which token of A stands for one of B.

Inside a task everything is columns: the ids of a run of texts are one list
array, flattened with the number of the text beside each id; ends are running
sums of the tokens' bytes, begun anew with each text; links are a hash join on
(text, end); a text's links are counted by a grouped aggregate.

Counts need the whole corpus, texts need their links' counts. Texts are worked on
in blocks of about ``BLOCK_BYTES``. A block counts its pairs, Spark adds up the
blocks, and every block gets the counts of its own pairs back. So a pair travels
once per block, not once per text or token, and one that stands in every text is
no hot key: it has one row a block.

Defined results: texts that are null, empty, or that either tokenizer does not
give back byte by byte (with one space in front) have no tokens, all counts are 0
and the groups are empty; repeated rows count as often as they come; ids of rows
are carried as they are, null included; an empty table gives no rows; columns
other than id and text are not read. A word, what stands between single spaces, is encoded
once by a Python worker: neither tokenizer joins over such a space.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortflow.llm.rows import text_of
from sortflow.plans.workspace import materialise

#: Characters of text worked on at once.
SLICE_CHARS = 1 << 20
#: Characters of words remembered.
MAX_CHARS = 1 << 23
#: Bytes of text in a block: the more, the fewer rows of pairs travel.
BLOCK_BYTES = 8 << 20
#: Where both tokenizers begin anew: at a single space, but for one after the character that stands for a space in B.
_CUT = re.compile(r"(?<=[^\s▁]) (?=\S)")
_SPACE = "▁"

_TEXTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pair array<int>, times array<long>"
_TEXT_COLUMNS = [c.split()[0] for c in _TEXTS.split(", ")]
_PAIRS = "a array<int>, b array<int>, n array<long>"
_IN_BLOCKS = f"block long, id long, {_TEXTS}, {_PAIRS}"
_ARROW = pa.schema(
    [("block", pa.int64()), ("id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string()), ("groups", pa.large_string())]
    + [("pair", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))]
    + [("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))]
)
_RESULT = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def byte_characters() -> dict[str, int]:
    """The byte behind every character of a byte-level vocabulary: printable bytes stand for themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def _column(tokens: dict[int, bytes]) -> pa.Array:
    return pa.array([tokens.get(i) for i in range(max(tokens) + 1)], pa.large_binary())


class ByteLevel:
    """Tokenizer A, from its JSON file."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        characters = byte_characters()
        spelt = {i: t for t, i in self.model.get_vocab(with_added_tokens=False).items()}
        self.tokens = _column({i: bytes(characters[c] for c in t) for i, t in spelt.items() if all(c in characters for c in t)})

    def __call__(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]


class Pieces:
    """Tokenizer B, from its model file; it puts the space in front itself."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.tokens = _column({i: self._bytes(i) for i in range(self.model.get_piece_size())})

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.model.is_byte(i) else piece.replace(_SPACE, " ").encode()

    def __call__(self, parts: list[str]) -> list[list[int]]:
        return self.model.encode(parts, num_threads=1)


def words_of(text: str) -> list[str]:
    """Words that, with a space before each, are the text with a space before it."""
    return _CUT.split(text)


@dataclass
class Encoded:
    """Tokens of a run of texts in one flat column, with the text of each and the byte, within its text, where it ends."""

    ids: pa.Array
    text: pa.Array
    end: pa.Array
    counts: np.ndarray

    def table(self, name: str) -> pa.Table:
        place = pa.array(np.arange(len(self.ids)))
        return pa.table({"text": self.text, "end": self.end, name: self.ids, f"at_{name}": place})


def _list_array(lists: list[list[int]]) -> pa.LargeListArray:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), pa.array(flat))


class Words:
    """Words a Python worker has met, each encoded once by both tokenizers. Beyond ``MAX_CHARS`` it starts anew."""

    def __init__(self, *encoders) -> None:
        self.encoders = encoders
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.ids = [_list_array([]) for _ in self.encoders]

    def __call__(self, words: list[str]) -> list[pa.LargeListArray]:
        """The ids of every word, by each tokenizer."""
        if self.chars > MAX_CHARS:
            self._forget()
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.chars += sum(map(len, new))
            self.ids = [pa.concat_arrays([old, _list_array(encode(new))]) for old, encode in zip(self.ids, self.encoders)]
        numbers = pa.array(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
        return [ids.take(numbers) for ids in self.ids]


def _by_text(words: pa.LargeListArray, counts: np.ndarray) -> pa.LargeListArray:
    """The ids of every text from those of its words."""
    borders = words.offsets.to_numpy()[np.concatenate([[0], np.cumsum(counts)])]
    return pa.LargeListArray.from_arrays(pa.array(borders - borders[0]), words.flatten())


def _gives_back(lists: pa.LargeListArray, tokens: pa.Array, wanted: list[bytes]) -> np.ndarray:
    """Whether the bytes of a text's tokens, joined, are the wanted ones."""
    said = tokens.take(lists.flatten())
    if said.null_count:
        said = pc.fill_null(said, b"")
    first = np.frombuffer(said.buffers()[1], np.int64)[said.offset :][lists.offsets.to_numpy()]
    data = memoryview(said.buffers()[2] or b"")
    return np.array([bytes(data[a:b]) == w for a, b, w in zip(first[:-1], first[1:], wanted)], bool)


def _encoded(lists: pa.LargeListArray, tokens: pa.Array) -> Encoded:
    """Flatten lists, number their texts, and sum up the bytes of their tokens text by text."""
    ids, text = pc.list_flatten(lists), pc.list_parent_indices(lists)
    running = pc.cumulative_sum(pc.binary_length(tokens.take(ids)))
    counts = np.diff(lists.offsets.to_numpy())
    before = np.concatenate([[0], running.to_numpy()])[lists.offsets.to_numpy()[:-1]]
    end = pc.subtract(running, pa.array(before).take(text))
    return Encoded(ids, text, end, counts)


def _spelt(a: pa.Array, b: pa.Array) -> pa.Array:
    """Decimal ids with what may follow them: ids of A with ``,`` then with ``|``, ids of B with ``,`` then with ``;``."""
    return pa.array([f"{i}{mark}" for size, marks in ((len(a), ",|"), (len(b), ",;")) for mark in marks for i in range(size)], pa.large_string())


class Aligner:
    """Both tokenizers, at work on runs of texts."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.words = Words(self.a, self.b)
        self.spelt = _spelt(self.a.tokens, self.b.tokens)

    def lists(self, texts: list[str | None]) -> tuple[pa.LargeListArray, pa.LargeListArray]:
        """The ids of every text by A and by B; none where either does not give the text back."""
        split = [words_of(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        both = [_by_text(ids, counts) for ids in self.words(list(chain.from_iterable(split)))]
        wanted = [(" " + t).encode() if t else b"" for t in texts]
        kept = pa.array(_gives_back(both[0], self.a.tokens, wanted) & _gives_back(both[1], self.b.tokens, wanted))
        none = pa.scalar([], both[0].type)
        return tuple(pc.if_else(kept, x, none) for x in both)

    def __call__(self, texts: list[str | None]) -> tuple[pa.Table, pa.Table]:
        """(n_a, n_b, n_groups, n_links, groups) of every text, and (text, a, b, times) of every pair of ids linked in it."""
        a, b = (_encoded(x, side.tokens) for x, side in zip(self.lists(texts), (self.a, self.b)))
        links = a.table("a").join(b.table("b"), ["text", "end"], join_type="inner", use_threads=False)
        links = links.take(pc.sort_indices(links, [("at_a", "ascending"), ("at_b", "ascending")]))
        text = links.column("text").to_numpy()
        n = np.bincount(text, minlength=len(texts))
        said = self._groups(a.ids.to_numpy(), b.ids.to_numpy(), *(links.column(c).to_numpy() + 1 for c in ("at_a", "at_b")), n)
        pairs = links.group_by(["text", "a", "b"], use_threads=False).aggregate([([], "count_all")])
        pairs = pairs.rename_columns(["text", "a", "b", "times"])
        counts = pa.table({"n_a": a.counts, "n_b": b.counts, "n_groups": n, "n_links": n, "groups": said})
        return counts, pairs

    def _groups(self, a: np.ndarray, b: np.ndarray, past_a: np.ndarray, past_b: np.ndarray, n: np.ndarray) -> pa.Array:
        """``a1,a2|b1;a3|b2`` of every text, from the tokens before each cut and the number of cuts in each text."""
        from_a, from_b = (np.concatenate([[0], past[:-1]]) if len(past) else past for past in (past_a, past_b))
        spelt = np.empty(len(a) + len(b), np.int64)
        place_a = np.arange(len(a)) + np.repeat(from_b, past_a - from_a)
        place_b = np.arange(len(b)) + np.repeat(past_a, past_b - from_b)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[past_a - 1], last_b[past_b - 1] = True, True
        known = len(self.a.tokens), len(self.b.tokens)
        spelt[place_a] = a + last_a * known[0]
        spelt[place_b] = b + 2 * known[0] + last_b * known[1]
        said = self.spelt.take(pa.array(spelt))
        ends = np.frombuffer(said.buffers()[1], np.int64)[: len(spelt) + 1]
        cuts = ends[np.concatenate([[0], past_a + past_b])][np.concatenate([[0], np.cumsum(n)])]
        data = memoryview(said.buffers()[2] or b"")
        return pa.array([bytes(data[x : max(x, y - 1)]).decode() for x, y in zip(cuts[:-1], cuts[1:])], pa.large_string())


@lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    """One for all tasks of a Python worker."""
    return Aligner(path_a, path_b)


def _slices(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    first, chars, held = 0, 0, []
    for k, value in enumerate(column):
        text = value.as_py()
        if held and chars + len(text or "") > SLICE_CHARS:
            yield first, held
            first, chars, held = k, 0, []
        held.append(text)
        chars += len(text or "")
    if held:
        yield first, held


def _rows(block: int, **columns) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    columns["block"] = pa.array([block] * size, pa.int64())
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in _ARROW], schema=_ARROW)


class _Block:
    """Texts of one block: their rows are held until the pairs of the block can be numbered."""

    def __init__(self) -> None:
        self.ids, self.counts, self.pairs = [], [], []
        self.texts = self.bytes = 0

    def add(self, ids: pa.Array, counts: pa.Table, pairs: pa.Table, size: int) -> None:
        number = pc.add(pairs.column("text"), self.texts)
        self.pairs.append(pairs.set_column(0, "text", number))
        self.ids.append(ids)
        self.counts.append(counts)
        self.texts += len(ids)
        self.bytes += size

    def close(self, block: int, whole: bool) -> Iterator[pa.RecordBatch]:
        """The rows of the texts, with the numbers of their pairs, and one row with the pairs."""
        links, counts = pa.concat_tables(self.pairs), pa.concat_tables(self.counts)
        pairs = links.group_by(["a", "b"], use_threads=False).aggregate([("times", "sum")])
        pairs = pairs.append_column("pair", pa.array(np.arange(pairs.num_rows), pa.int32()))
        links = links.join(pairs.select(["a", "b", "pair"]), ["a", "b"], join_type="inner", use_threads=False)
        links = links.take(pc.sort_indices(links, [("text", "ascending"), ("pair", "ascending")]))
        borders = pa.array(np.searchsorted(links.column("text").to_numpy(), np.arange(self.texts + 1)), pa.int32())
        said = counts.column("groups").combine_chunks()
        digest = pa.array([hashlib.sha256(s.as_buffer()).hexdigest() if len(s.as_buffer()) else "" for s in said])
        numbers = {c: counts.column(c).combine_chunks() for c in ("n_a", "n_b", "n_groups", "n_links")}
        by_text = {c: pa.ListArray.from_arrays(borders, links.column(c).combine_chunks()) for c in ("pair", "times")}
        groups = {"groups": said} if whole else {}
        yield _rows(block, id=pa.concat_arrays(self.ids), groups_sha256=digest, **numbers, **by_text, **groups)
        if pairs.num_rows:
            one = pa.array([0, pairs.num_rows], pa.int32())
            columns = {c: pairs.column(k).combine_chunks() for c, k in (("a", "a"), ("b", "b"), ("n", "times_sum"))}
            yield _rows(block, **{c: pa.ListArray.from_arrays(one, v) for c, v in columns.items()})


def _in_blocks(path_a: str, path_b: str, whole: bool, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = _aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        block = _Block()
        for batch in batches:
            for first, texts in _slices(batch.column(1)):
                ids = batch.column(0).slice(first, len(texts))
                block.add(ids, *aligner(texts), sum(len(t.encode()) for t in texts if t))
                if block.bytes >= block_bytes:
                    yield from block.close(number, whole)
                    block, number = _Block(), number + 1
        if block.texts:
            yield from block.close(number, whole)

    return run


def _weighed(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """Add up, for every text of a block, the counts of its links and the links that are best."""
    order = pc.sort_indices(pairs.column("pair"))
    count, best = (pairs.column(c).take(order).to_numpy() for c in ("count", "best"))
    lists = texts.column("pair").combine_chunks()
    row = pc.list_parent_indices(lists).to_numpy()
    pair, times = (pc.list_flatten(texts.column(c).combine_chunks()).to_numpy() for c in ("pair", "times"))
    sums = np.zeros((2, texts.num_rows), np.int64)
    np.add.at(sums[0], row, times * best[pair])
    np.add.at(sums[1], row, times * count[pair])
    kept = [c.split()[0] for c in _RESULT.split(", ")]
    made = {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
    return pa.table({c: made[c] if c in made else texts.column(c) for c in kept})


class Alignment:
    """Both tokenizers over one table, encoded once and written."""

    def __init__(
        self,
        docs: DataFrame,
        path_a: str,
        path_b: str,
        id_col: str = "doc_id",
        text_col: str = "text",
        groups: bool = False,
        block_bytes: int = BLOCK_BYTES,
    ) -> None:
        self.id_col, self.groups = id_col, groups
        rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(docs, text_col).alias("text"))
        blocks = rows.mapInArrow(_in_blocks(path_a, path_b, groups, block_bytes), _IN_BLOCKS)
        self.blocks = materialise(blocks, "alignment-blocks")
        listed = self.blocks.where("a is not null").select("block", F.posexplode(F.arrays_zip("a", "b", "n")).alias("pair", "link"))
        self.pairs = listed.select("block", "pair", "link.a", "link.b", "link.n")
        self.counts = materialise(self._counts(), "alignment-counts")

    def _counts(self) -> DataFrame:
        counts = self.pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
        # One row for each id of B: no more than its vocabulary has.
        highest = F.broadcast(counts.groupBy("b").agg(F.max("count").alias("highest")))
        return counts.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("highest")).cast("int").alias("best"))

    def texts(self) -> DataFrame:
        """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups) of every row."""
        weighed = self.pairs.select("block", "pair", "a", "b").join(self.counts, ["a", "b"])
        weighed = weighed.select("block", "pair", "count", "best")
        texts = self.blocks.where("a is null").select(F.col("block").alias("home"), "id", *_TEXT_COLUMNS)
        found = texts.groupBy("home").cogroup(weighed.groupBy("block")).applyInArrow(_weighed, _RESULT)
        found = found if self.groups else found.drop("groups")
        return found.withColumnRenamed("id", self.id_col)


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, **options) -> DataFrame:
    """Counts, and with ``groups=True`` the aligned groups, of every row of ``docs``; see ``Alignment``."""
    return Alignment(docs, path_a, path_b, **options).texts()


def link_counts(docs: DataFrame, path_a: str, path_b: str, **options) -> DataFrame:
    """(a, b, count, best): how often two ids end together in the corpus, and whether no other id does so more often with ``b``."""
    return Alignment(docs, path_a, path_b, **options).counts
