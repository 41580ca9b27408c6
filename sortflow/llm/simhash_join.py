"""SimHash near-duplicates by BK-trees.

A fingerprint has a bit for every bit of a 64-bit hash; it is set if it is set in
more than half of the hashes of a text's word shingles, repeats included. Texts
whose fingerprints differ in at most ``radius`` bits are linked, and links are
followed to the end.

Distinct fingerprints are searched, never texts. Two fingerprints within the
radius agree in all but ``radius`` of the blocks that their bits are cut into, so
they meet in the shard of some choice of blocks: one row per fingerprint and
choice, 6 for a radius of 2 and 4 blocks, in shards named by 32 bits. In a shard a
BK-tree hangs every fingerprint below its parent by their distance; a query
follows only edges whose distance is within the radius of its own to the node.

A shard of more than ``BLOCK`` fingerprints is cut by hash into blocks. First every
block has its own tree and is searched by itself; then the tree of a block is sent
to the other blocks of its shard, and queries skip what is of their component
already. No task returns pairs: it unites what it finds, and returns at most one
row per fingerprint, with the smallest one of its component.

Defined results: a null, empty or wordless text has fingerprint 0 and is linked
like any other; texts of fewer words than a shingle are one shingle; rows that
repeat are linked; a null id takes no part in the smallest id, and a component
without any id has a null one; an empty table gives no rows; columns other than
id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortflow.llm.components import Union, connected_components
from sortflow.llm.rows import text_of
from sortflow.llm.wordbytes import SOLID_BYTES, Texts, by_row, find_words, text_slices
from sortflow.plans.workspace import materialise

WIDTH = 3
RADIUS = 2
SEED = 42
#: Blocks of bits beyond the radius: the more, the smaller the shards and the more of them a fingerprint visits.
SPARE_BLOCKS = 2
#: Fingerprints of one tree.
BLOCK = 8_192
#: Rows of shards that a task takes at once, if no single shard is larger.
BUCKET = 1 << 16
#: Pairs of a query and a node that are looked at in one step.
FRONTIER = 1 << 20
_BITS = 64


def shingle_hashes(texts: Texts, width: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle of every row, repeats included."""
    words = find_words(texts, SOLID_BYTES)
    # Words one space apart, so that every shingle is one stretch of bytes.
    sizes = words.end - words.start
    start = np.cumsum(sizes + 1) - sizes - 1
    joined = np.full(int((sizes + 1).sum()), 32, np.uint8)
    place = np.arange(int(sizes.sum()))
    shift = np.cumsum(sizes) - sizes
    joined[place + np.repeat(start - shift, sizes)] = texts.data[place + np.repeat(words.start - shift, sizes)]
    border = by_row(words.row, texts.rows)
    counts = np.diff(border)
    n = max(0, len(sizes) - width + 1)
    first = np.flatnonzero(words.row[:n] == words.row[width - 1 :]) if n else np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    row = np.concatenate([words.row[first], short])
    begins = np.concatenate([start[first], start[border[short]]])
    last = np.concatenate([first + width - 1, border[short + 1] - 1])
    ends = start[last] + sizes[last]
    data, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[a:b], seed) for a, b in zip(begins.tolist(), ends.tolist())), np.uint64, len(begins))
    return row, hashes


def fingerprints(row: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """The fingerprint of every row: bits that more than half of its hashes have; 0 without hashes."""
    order = np.argsort(row, kind="stable")
    border = by_row(row[order], rows)
    out = np.zeros(rows, np.uint64)
    counts = np.diff(border)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    hashes = hashes[order]
    for bit in range(_BITS):
        ones = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(1), border[full])
        out[full] |= (2 * ones > counts[full].astype(np.uint64)).astype(np.uint64) << np.uint64(bit)
    return out


def _marked(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_slices(batch.column(1)):
                marks = fingerprints(*shingle_hashes(texts, width), texts.rows)
                ids = batch.column(0).slice(texts.first, texts.rows)
                yield pa.RecordBatch.from_arrays([ids, pa.array(marks.view(np.int64))], ["id", "mark"])

    return run


def shard_keys(marks: np.ndarray, radius: int, blocks: int) -> np.ndarray:
    """One key per choice of ``blocks - radius`` blocks of bits; marks within the radius have one in common at least."""
    borders = np.arange(blocks + 1) * _BITS // blocks
    keys = []
    for number, choice in enumerate(combinations(range(blocks), blocks - radius)):
        key = np.full(len(marks), number, np.uint64)
        for block in choice:
            size = int(borders[block + 1] - borders[block])
            part = (marks >> np.uint64(borders[block])) & np.uint64((1 << size) - 1)
            key = (key << np.uint64(size)) | part
        keys.append(key)
    return np.stack(keys, axis=1)


class BKForest:
    """The trees that adding marks one by one makes, one for each shard; children are keyed by their distance to the parent.

    All marks of all trees go down together, a level at a time: those that stand at one node at
    one distance follow the first of them, which becomes the child.
    """

    def __init__(self, marks: np.ndarray, tree: np.ndarray) -> None:
        """``tree`` is the number, from 0, of the tree of every mark."""
        self.marks = marks
        n = len(marks)
        _, self.roots, self.sizes = np.unique(tree, return_index=True, return_counts=True)
        parent, distance = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        going = np.setdiff1d(np.arange(n), self.roots)
        node = self.roots[tree[going]]
        while len(going):
            apart = self._apart(marks[going], node)
            edge = node * (_BITS + 1) + apart
            _, first, group = np.unique(edge, return_index=True, return_inverse=True)
            child = going[first]
            parent[child], distance[child] = node[first], apart[first]
            stays = np.ones(len(going), bool)
            stays[first] = False
            going, node = going[stays], child[group[stays]]
        edges = parent * (_BITS + 1) + distance
        self.order = np.argsort(edges, kind="stable")
        self.edges = edges[self.order]

    def _apart(self, marks: np.ndarray, node: np.ndarray) -> np.ndarray:
        return np.bitwise_count(marks ^ self.marks[node]).astype(np.int64)

    def search(self, queries: np.ndarray, tree: np.ndarray, radius: int, wanted=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) within the radius in the query's tree, in parts; ``wanted(query, node)`` may leave pairs out."""
        part = (np.cumsum(self.sizes[tree]) // FRONTIER).astype(np.int64) if len(tree) else tree
        for query in np.split(np.arange(len(queries)), np.flatnonzero(np.diff(part)) + 1):
            node = self.roots[tree[query]]
            while len(query):
                apart = self._apart(queries[query], node)
                near = apart <= radius
                if wanted is not None:
                    near[near] = wanted(query[near], node[near])
                if near.any():
                    yield query[near], node[near]
                base = node * (_BITS + 1)
                low = np.searchsorted(self.edges, base + np.maximum(apart - radius, 0), side="left")
                high = np.searchsorted(self.edges, base + np.minimum(apart + radius, _BITS), side="right")
                fan = high - low
                query = np.repeat(query, fan)
                first = np.repeat(low - np.cumsum(fan) + fan, fan)
                node = self.order[first + np.arange(len(first))]


def _united(radius: int):
    """Search all shards of a bucket by their trees; (a, b) for every component that was united with one of a smaller mark."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        signed, member = np.unique(table.column("mark").to_numpy(), return_inverse=True)
        known, side = table.column("component").to_numpy(), table.column("side").to_numpy()
        _, shard = np.unique(table.column("shard").to_numpy(), return_inverse=True)
        union = Union(len(signed))
        _, first, group = np.unique(known, return_index=True, return_inverse=True)
        union.unite(member, member[first][group])
        given = union.roots(np.arange(len(signed)))
        marks = signed.view(np.uint64)
        here = np.flatnonzero(side == 0)
        trees, tree = np.unique(shard[here], return_inverse=True)
        forest = BKForest(marks[member[here]], tree)
        # Blocks of one side are searched by themselves, others by the other side.
        both = np.zeros(shard.max(initial=-1) + 1, bool)
        both[shard[side == 1]] = True
        there = np.flatnonzero(np.where(both[shard], side == 1, side == 0) & np.isin(shard, trees))
        asked, nodes = member[there], member[here]
        apart = lambda q, n: union.roots(asked[q]) != union.roots(nodes[n])
        for query, node in forest.search(marks[asked], np.searchsorted(trees, shard[there]), radius, apart):
            union.unite(asked[query], nodes[node])
        root = union.roots(np.arange(len(signed)))
        new = np.flatnonzero((given == np.arange(len(signed))) & (root != given))
        return pa.table({"a": pa.array(signed[new]), "b": pa.array(signed[root[new]])})

    return run


def _sharded(radius: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column(0).to_numpy()
            keys = shard_keys(signed.view(np.uint64), radius, blocks)
            columns = np.tile(np.arange(keys.shape[1], dtype=np.int32), len(signed)), keys.ravel().view(np.int64), np.repeat(signed, keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["choice", "place", "mark"])

    return run


def _search(rows: DataFrame, radius: int) -> DataFrame:
    """Links in all shards. Shards are dealt to buckets of about ``BUCKET`` rows, so that a task takes many small ones at once."""
    buckets = max(1, -(-rows.count() // BUCKET))
    # Two shards of one hash are one: that only compares more.
    shard = F.xxhash64("choice", "place", "low", "high")
    rows = rows.select(shard.alias("shard"), F.col("side").cast("int").alias("side"), "mark", "component")
    rows = rows.withColumn("bucket", F.pmod("shard", F.lit(buckets)))
    return materialise(rows.groupBy("bucket").applyInArrow(_united(radius), "a long, b long"), "simhash-links")


def _labelled(rows: DataFrame, components: DataFrame) -> DataFrame:
    named = components.select(F.col("node").alias("mark"), "component")
    return rows.join(named, "mark", "left").withColumn("component", F.coalesce("component", "mark"))


def link_marks(marks: DataFrame, radius: int = RADIUS, spare_blocks: int = SPARE_BLOCKS) -> DataFrame:
    """(node, component) of all distinct 64-bit marks with another within the radius; ``marks`` has one long column, mark."""
    place = ["choice", "place"]
    sharded = marks.mapInArrow(_sharded(radius, radius + spare_blocks), "choice int, place long, mark long")
    sizes = sharded.groupBy(place).agg(F.count("*").alias("size")).where("size > 1")
    sizes = sizes.select(*place, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    met = materialise(sharded.join(sizes, place), "simhash-shards")
    met = met.withColumn("block", F.pmod(F.xxhash64("mark"), F.col("blocks")).cast("int"))
    block, itself = F.col("block"), F.col("mark").alias("component")
    links = _search(met.select(*place, block.alias("low"), block.alias("high"), F.lit(0).alias("side"), "mark", itself), radius)
    components = connected_components(links)
    large = met.where("blocks > 1")
    if large.isEmpty():
        return components
    labelled = materialise(_labelled(large, components), "simhash-large")
    mixed = labelled.groupBy(place).agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least != most")
    open_ = labelled.join(mixed.select(place), place, "left_semi")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    across = open_.select(*place, "block", "mark", "component", other).where("block != other")
    sides = {"low": F.least("block", "other"), "high": F.greatest("block", "other"), "side": F.col("block") > F.col("other")}
    more = _search(across.withColumns(sides), radius)
    return connected_components(links.unionByName(more))


def simhash_components(
    docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", spare_blocks: int = SPARE_BLOCKS
) -> DataFrame:
    """(id, fingerprint, component_id) for every row: 16 hexadecimal digits and the smallest id linked with it."""
    if radius < 0 or radius + spare_blocks > _BITS:
        raise ValueError("radius and spare blocks must fit 64 bits")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    rows = materialise(rows.mapInArrow(_marked(width), "id long, mark long"), "simhash-rows")
    nodes = materialise(rows.groupBy("mark").agg(F.min("id").alias("smallest")), "simhash-nodes")
    components = link_marks(nodes.select("mark"), radius, spare_blocks)
    placed = _labelled(nodes, components)
    least = placed.groupBy("component").agg(F.min("smallest").alias("component_id"))
    named = materialise(placed.join(least, "component").select("mark", "component_id"), "simhash-named")
    # Both sides are read as written, so that a mark of very many rows can be split.
    found = rows.join(named, "mark")
    mark = F.lower(F.lpad(F.hex("mark"), 16, "0"))
    return found.select(F.col("id").alias(id_col), mark.alias("fingerprint"), "component_id")
