"""N-gram Jaccard self-join with a count-vector R-tree: groups of linked texts.

A text is the set of its word shingles. Shingles are hashed into groups; the
counts per group are the text's point. Two sets cannot share more than the sum,
over the groups, of the smaller count, so a pair, or a whole node of a tree over
points, is dropped when that sum stays below what the threshold demands.

In the count vectors of unrelated texts no single coordinate separates, so one
tree over all texts would compare nearly all of them. Over a cluster, the trees
therefore stand below cells. Shingles are dealt into slices; sets that differ in
at most d shingles differ in at most d slices, d following from the threshold and
the size, by classes of sizes. With d + t slices, t are equal. A text goes to one
cell per slice that is not empty, named by the shingles in it: nobody meets in
emptiness. If fewer than t slices of either text are empty, two linked texts meet.
Texts with t empty slices or more are dealt once more, by another hash, and so on
for ``DEALS`` times; only what is left by then, practically nothing, visits the cells of
its empty slices. A text also visits the cells of the next class if a partner may be there.

No cell is gathered and no pair listed:

1. Texts with equal sets are one node.
2. Every cell names its smallest node. A node is compared with the one named most
   often, then with the others unless they are of one component by now.
3. Nodes that meet under one name and are still of different components are searched by
   trees of at most ``BLOCK`` points, cut by hash, block against block: first by
   counts alone, to see which nodes have any partner; then their sets are sent,
   and the task verifies what the tree lets through. It unites what is linked and
   returns at most one row per component; pairs united already are skipped.

Sets, nodes and shingles are told apart by 64-bit hashes.

Defined results: a null, empty or wordless text has an empty set and is a
component of its own; texts of fewer words than a shingle are one shingle; rows
that repeat are linked; a null id takes no part in the smallest id, and a
component without any id has a null one; an empty table gives no rows; columns
other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortflow.llm.components import Union, connected_components
from sortflow.llm.rows import ROW, release_shuffles, text_of, unpack, whole_row
from sortflow.llm.wordbytes import SOLID_BYTES, Texts, by_row, find_words, mix, run_hashes, span_hashes, text_slices, word_run_hashes
from sortflow.plans.broadcasting import checked_broadcast
from sortflow.plans.workspace import materialise

GROUPS = 64
#: Groups of the second bound, for the pairs that pass the first.
FINE_GROUPS = 1_024
_MOST = np.iinfo(np.uint16).max
CLASS_RATIO = 1.6
#: Times that a text with many empty slices is dealt.
DEALS = 4
LEAF = 32
FAN = 16
BLOCK = 2_048
#: Rows of groups that a task takes at once, if no single group is larger.
BUCKET = 1 << 13
#: Shingles of the sets that a task takes at once, if no single group has more, and of one block of a group.
SET_SHINGLES = 1 << 21
#: Queries of a tree whose pairs are held at once.
AT_ONCE = 256
#: Pairs whose counts are held at once.
PAIRS = 1 << 13
#: Ids broadcast at most, 16 bytes each.
MAX_IDS = 500_000
_SLICE_SALTS = [np.uint64(0x2545F4914F6CDD1D * (2 * k + 1) % (1 << 64)) for k in range(DEALS)]


def shingle_sets(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of every distinct shingle, sorted by row and hash."""
    words = find_words(texts, SOLID_BYTES)
    hashes = span_hashes(texts, words.start, words.end)
    first, runs = run_hashes(words, hashes, width)
    row = words.row[first]
    border = by_row(words.row, texts.rows)
    counts = np.diff(border)
    short = np.flatnonzero((counts > 0) & (counts < width))
    row = np.concatenate([row, short])
    runs = np.concatenate([runs, word_run_hashes(hashes, border[short], border[short + 1])])
    order = np.lexsort((runs, row))
    row, runs = row[order], runs[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (runs[1:] != runs[:-1])
    return row[new], runs[new]


def _sum_by(index: np.ndarray, hashes: np.ndarray, size: int) -> np.ndarray:
    """Sums of 64-bit hashes, modulo 2^64, by index."""
    low = np.bincount(index, (hashes & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    high = np.bincount(index, (hashes >> np.uint64(32)).astype(np.float64), size)
    return (high.astype(np.uint64) << np.uint64(32)) + low.astype(np.uint64)


def set_nodes(row: np.ndarray, shingles: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, hash) of every set; equal sets have equal hashes."""
    sizes = np.bincount(row, minlength=rows)
    return sizes, mix(_sum_by(row, mix(shingles), rows) + sizes.astype(np.uint64))


class SizeClasses:
    """Classes of set sizes with the number of slices that a pair needs whose larger set is in the class.

    Where linked sets cannot differ at all, they are one node already and need no slices.
    """

    def __init__(self, percent: int, largest: int) -> None:
        self.percent = percent
        starts = [1]
        while starts[-1] <= largest * 100 // percent:
            starts.append(max(starts[-1] + 1, int(starts[-1] * CLASS_RATIO)))
        self.starts = np.array(starts, np.int64)
        self.differ = (100 - percent) * 2 * (self.starts[1:] - 1) // (100 + percent)
        self.equal = np.array([self._equal(n, d) for n, d in zip(self.starts[:-1].tolist(), self.differ.tolist())])
        self.slices = np.where(self.differ == 0, 0, self.differ + self.equal)

    @staticmethod
    def _equal(size: int, differ: int) -> int:
        """How many slices beyond ``differ`` make it rare that so many of the slices of a set of ``size`` are empty."""
        for equal in range(1, differ + 8):
            empty = (differ + equal) * np.exp(-size / (differ + equal))
            if empty + 2 * np.sqrt(empty) < equal:
                break
        return equal

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, sizes, side="right") - 1


def cell_keys(row: np.ndarray, shingles: np.ndarray, rows: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every cell that a text visits."""
    sizes = np.bincount(row, minlength=rows)
    classes = SizeClasses(percent, int(sizes.max(initial=1)))
    own = classes.of(np.maximum(sizes, 1))
    last = classes.of(np.maximum(sizes, 1) * 100 // percent)
    weight = mix(shingles)
    out_rows, out_keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for step in range(int((last - own).max(initial=0)) + 1):
        level = own + step
        dealt = (level <= last) & (sizes > 0)
        level = np.minimum(level, len(classes.slices) - 1)
        dealt &= classes.slices[level] > 0
        for deal, salt in enumerate(_SLICE_SALTS):
            slices = np.where(dealt, classes.slices[level], 0)
            total = int(slices.sum())
            if not total:
                break
            base = np.cumsum(slices) - slices
            used = dealt[row]
            place = base[row[used]] + (mix(shingles[used] ^ salt) % slices[row[used]].astype(np.uint64)).astype(np.int64)
            counts, sums = np.bincount(place, minlength=total), _sum_by(place, weight[used], total)
            owner = np.repeat(np.arange(rows), slices)
            number = np.arange(total) - base[owner]
            dealt = dealt & (np.bincount(owner, counts == 0, rows) >= classes.equal[level])
            wanted = counts > 0
            if deal == DEALS - 1:
                wanted |= dealt[owner]
            name = mix((level[owner].astype(np.uint64) << np.uint64(40)) + (np.uint64(deal) << np.uint64(32)) + number.astype(np.uint64))
            out_rows.append(owner[wanted])
            out_keys.append(mix(sums + name)[wanted])
    return np.concatenate(out_rows), np.concatenate(out_keys)


def group_counts(row: np.ndarray, shingles: np.ndarray, rows: int, groups: int = GROUPS) -> np.ndarray:
    group = (mix(shingles) % np.uint64(groups)).astype(np.int64)
    return np.bincount(row * groups + group, minlength=rows * groups).reshape(rows, groups)


def needed_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of linked sets of sizes ``a`` and ``b``."""
    return -(-percent * (a + b) // (100 + percent))


class CountTree:
    """R-tree over count vectors, bulk-loaded by size and counts; nodes keep largest counts and size bounds."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, components: np.ndarray) -> None:
        widest = np.argsort(points.var(axis=0))[::-1][:2]
        self.order = np.lexsort((*points[:, widest].T, sizes, components))
        self.points, self.sizes, self.components = points[self.order], sizes[self.order], components[self.order]
        self.levels = []
        top, least, most = self.points, self.sizes, self.sizes
        low, high = self.components, self.components
        width = LEAF
        while True:
            cuts = np.arange(0, len(top), width)
            top = np.maximum.reduceat(top, cuts)
            least, most = np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((width, top, least, most, low, high))
            if len(cuts) == 1:
                break
            width = FAN

    def search(self, points: np.ndarray, sizes: np.ndarray, components: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) of all pairs of different components that the bound lets through."""
        bounds = [(self.points, self.sizes, self.sizes, self.components, self.components), *(level[1:] for level in self.levels)]
        query, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        query, node = self._let_through(query, node, points, sizes, components, percent, *bounds[-1])
        for (width, *_), below in zip(self.levels[::-1], bounds[-2::-1]):
            found = [(query[:0], node[:0])]
            # Children are made and looked at some at a time.
            for at in range(0, len(query), max(PAIRS // width, 1)):
                part = slice(at, at + max(PAIRS // width, 1))
                child = (node[part, None] * width + np.arange(width)).ravel()
                inside = child < len(below[0])
                asked = np.repeat(query[part], width)[inside]
                found.append(self._let_through(asked, child[inside], points, sizes, components, percent, *below))
            query, node = (np.concatenate(parts) for parts in zip(*found))
        return query, self.order[node]

    @staticmethod
    def _let_through(query, node, points, sizes, components, percent, top, least, most, low, high):
        size, own = sizes[query], components[query]
        ok = (low[node] != own) | (high[node] != own)
        ok &= (percent * least[node] <= 100 * size) & (percent * size <= 100 * most[node])
        query, node = query[ok], node[ok]
        kept = []
        for at in range(0, len(query), PAIRS):
            q, x = query[at : at + PAIRS], node[at : at + PAIRS]
            shared = np.minimum(points[q], top[x]).sum(axis=1, dtype=np.int64)
            kept.append(shared >= needed_overlap(sizes[q], least[x], percent))
        good = np.concatenate(kept) if kept else np.zeros(0, bool)
        return query[good], node[good]


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, pa.int64())


def _nodes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_slices(batch.column(1)):
                row, shingles = shingle_sets(texts, width)
                sizes, node = set_nodes(row, shingles, texts.rows)
                counts = pa.array([c.tobytes() for c in group_counts(row, shingles, texts.rows).astype("<u4")], pa.binary())
                given = {name: batch.column(name).slice(texts.first, texts.rows) for name in ("id", "place", "digest")}
                yield _batch(**given, n=_longs(sizes), node=_longs(node), counts=counts)

    return run


def _cells(width: int, percent: int):
    """Cells and nodes, once for all copies in a slice of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_slices(batch.column(0)):
                row, shingles = shingle_sets(texts, width)
                _, node = set_nodes(row, shingles, texts.rows)
                _, first, copy = np.unique(node, return_index=True, return_inverse=True)
                one = first[copy] == np.arange(texts.rows)
                mine = one[row]
                owner, key = cell_keys(row[mine], shingles[mine], texts.rows, percent)
                yield _batch(key=_longs(key), node=_longs(node[owner]))

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, node) of all nodes of a cell but the smallest, from rows sorted by cell and node."""
    key = first = last = None
    for batch in batches:
        keys, nodes = (batch.column(c).to_numpy() for c in ("key", "node"))
        if not len(keys):
            continue
        opens = np.append(True, keys[1:] != keys[:-1])
        opens[0] = keys[0] != key
        begin = np.maximum.accumulate(np.where(opens, np.arange(len(keys)), -1))
        firsts = np.where(begin >= 0, nodes[begin], first if first is not None else 0)
        new = np.append(opens[0] or nodes[0] != last, nodes[1:] != nodes[:-1])
        wanted = (nodes != firsts) & (new | opens)
        key, first, last = keys[-1], firsts[-1], nodes[-1]
        yield _batch(first=_longs(firsts[wanted]), node=_longs(nodes[wanted]))


def _sent(width: int):
    """The points and sets of the nodes that a bucket asks for, from a text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_slices(batch.column(0)):
                row, shingles = shingle_sets(texts, width)
                sizes, node = set_nodes(row, shingles, texts.rows)
                border = by_row(row, texts.rows)
                sets = pa.array([shingles[a:b].tobytes() for a, b in zip(border[:-1], border[1:])], pa.binary())
                counts = pa.array([c.tobytes() for c in group_counts(row, shingles, texts.rows).astype("<u4")], pa.binary())
                asked, to = (batch.column(c).slice(texts.first, texts.rows) for c in ("node", "bucket"))
                rows = _batch(to=to, point=_longs(node), size=_longs(sizes), vector=counts, data=sets)
                # Other texts may have the same id.
                yield rows.filter(pa.array(asked.to_numpy() == node.view(np.int64)))

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_slices(batch.column(0)):
                row, shingles = shingle_sets(texts, width)
                _, node = set_nodes(row, shingles, texts.rows)
                border = by_row(row, texts.rows)
                sets = [shingles[a:b].tobytes() for a, b in zip(border[:-1], border[1:])]
                yield _batch(node=_longs(node), data=pa.array(sets, pa.binary()))

    return run


def _fine_counts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_slices(batch.column(0), 1 << 20):
                row, shingles = shingle_sets(texts, width)
                _, node = set_nodes(row, shingles, texts.rows)
                # Two bytes a group: a count that does not fit is the largest, and such sets are bounded by the coarse groups alone.
                counts = [np.minimum(c, _MOST).astype("<u2").tobytes() for c in group_counts(row, shingles, texts.rows, FINE_GROUPS)]
                yield _batch(node=_longs(node), data=pa.array(counts, pa.binary()))

    return run


def _fine_pass(sizes_x: np.ndarray, sizes_y: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether fine counts, row by row, can reach the overlap."""
    shared = np.minimum(x, y).sum(axis=1, dtype=np.int64)
    capped = (x == _MOST).any(axis=1) & (y == _MOST).any(axis=1)
    return capped | (shared >= needed_overlap(sizes_x, sizes_y, percent))


def _rows_of(column: pa.Array | pa.ChunkedArray, kind: str, width: int) -> np.ndarray:
    """The values of a binary column as rows of ``width`` numbers; a column of one chunk is not copied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()
    if not len(column):
        return np.zeros((0, width), kind)
    _, offsets, data = column.buffers()
    borders = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    first, last = int(borders[column.offset]), int(borders[column.offset + len(column)])
    return np.frombuffer(data[first:last], kind).reshape(-1, width)


def _fine(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return _rows_of(column, "<u2", FINE_GROUPS)


def _bounded_finely(percent: int):
    """Drop pairs whose counts over finer groups cannot reach the overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                sizes = (part.column(c).to_numpy() for c in ("n_a", "n_b"))
                yield part.select([0, 1]).filter(pa.array(_fine_pass(*sizes, _fine(part.column("of_a")), _fine(part.column("of_b")), percent)))

    return run


def _counts(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return _rows_of(column, "<u4", GROUPS)


def _bounded(percent: int):
    """Drop pairs whose count vectors cannot reach the overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (batch.column(i).to_numpy() for i in (2, 4))
                shared = np.minimum(_counts(batch.column(3)), _counts(batch.column(5))).sum(axis=1, dtype=np.int64)
                ok = (shared >= needed_overlap(a, b, percent)) & (np.minimum(a, b) * 100 >= percent * np.maximum(a, b))
                yield batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array(ok))

    return run


def _verified(percent: int):
    """Keep pairs whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def _pairs(tree: CountTree | None, points, sizes, components, at: slice, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) let through of some queries; without a tree, of a small group's later points."""
    if tree is not None:
        return tree.search(points[at], sizes[at], components[at], percent)
    query, point = np.triu_indices(len(points), 1)
    return CountTree._let_through(query, point, points, sizes, components, percent, points, sizes, sizes, components, components)


def _groups_of(shard: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(points, queries, small) of every shard: a block against another one, or against itself."""
    order = np.lexsort((side, shard))
    for rows in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        one, two = rows[side[rows] == 0], rows[side[rows] == 1]
        if not len(two):
            yield one, one, len(one) <= LEAF
        elif len(one):
            yield one, two, False


def _with_partners(percent: int):
    """(shard, side, node, component) of the nodes that the bounds, over coarse and fine groups, leave a partner of another component."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        shard, side, sizes, components = (table.column(c).to_numpy() for c in ("shard", "side", "n", "component"))
        counts, fine, kept = _counts(table.column("counts")), _fine(table.column("data")), np.zeros(len(shard), bool)
        for one, two, small in _groups_of(shard, side):
            tree = None if small else CountTree(counts[one], sizes[one], components[one])
            for at in range(0, len(two) if tree is not None else 1, AT_ONCE):
                part = slice(at, at + AT_ONCE)
                query, point = _pairs(tree, counts[two], sizes[two], components[two], part, percent)
                query, point = two[query + (at if tree is not None else 0)], one[point]
                # What is kept already needs no further partner.
                open_ = ~(kept[query] & kept[point])
                query, point = query[open_], point[open_]
                for begin in range(0, len(query), AT_ONCE):
                    q, p = query[begin : begin + AT_ONCE], point[begin : begin + AT_ONCE]
                    ok = _fine_pass(sizes[q], sizes[p], fine[q], fine[p], percent)
                    kept[q[ok]] = kept[p[ok]] = True
        return table.select(["shard", "side", "node", "component"]).filter(pa.array(kept))

    return run


class _Sets:
    """Sets of shingles as numbers, for many comparisons with one of them."""

    def __init__(self, nodes: np.ndarray, data: list[bytes]) -> None:
        sets = [np.frombuffer(data[x], "<u8") for x in nodes.tolist()]
        self.at = dict(zip(nodes.tolist(), range(len(nodes))))
        self.sizes = np.array([len(x) for x in sets], np.int64)
        known, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.sets = np.split(flat.astype(np.int32), np.cumsum(self.sizes)[:-1])
        self.seen = np.zeros(len(known), np.int64)

    def linked(self, one: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Which of the others are similar enough."""
        mine = self.sets[self.at[one]]
        others = [self.at[x] for x in others.tolist()]
        self.seen[mine] = 1
        sizes = self.sizes[others]
        shared = np.add.reduceat(self.seen[np.concatenate([self.sets[x] for x in others])], np.cumsum(sizes) - sizes)
        self.seen[mine] = 0
        return 100 * shared >= percent * (len(mine) + sizes - shared)


def _united(percent: int):
    """(a, b) for every component of a bucket that is linked with one named before it."""

    def run(rows: pa.Table, points: pa.Table) -> pa.Table:
        rows, points = rows.combine_chunks(), points.combine_chunks()
        nodes, once = np.unique(points.column("point").to_numpy(), return_index=True)
        points = points.take(pa.array(once))
        where = np.searchsorted(nodes, rows.column("node").to_numpy())
        shard, side, known = (rows.column(c).to_numpy() for c in ("shard", "side", "component"))
        counts, sizes, data = _counts(points.column("vector")), points.column("size").to_numpy(), points.column("data").to_pylist()
        union = Union(len(nodes))
        _, first, group = np.unique(known, return_index=True, return_inverse=True)
        union.unite(where, where[first][group])
        given = union.roots(np.arange(len(nodes)))
        for one, two, small in _groups_of(shard, side):
            one, two = where[one], where[two]
            sets = _Sets(np.union1d(one, two), data)
            tree = None if small else CountTree(counts[one], sizes[one], given[one])
            for at in range(0, len(two) if tree is not None else 1, AT_ONCE):
                query, point = _pairs(tree, counts[two], sizes[two], given[two], slice(at, at + AT_ONCE), percent)
                query, point = two[query + (at if tree is not None else 0)], one[point]
                grouped = np.argsort(query, kind="stable")
                query, point = query[grouped], point[grouped]
                for part in np.split(np.arange(len(query)), np.flatnonzero(np.diff(query)) + 1):
                    apart = part[union.roots(point[part]) != union.roots(query[part])] if len(part) else part
                    if len(apart):
                        others = point[apart]
                        others = others[sets.linked(int(query[apart[0]]), others, percent)]
                        union.unite(np.full(len(others), query[apart[0]]), others)
        root = union.roots(np.arange(len(nodes)))
        new = np.flatnonzero((given == np.arange(len(nodes))) & (root != given))
        return pa.table({"a": pa.array(nodes[new]), "b": pa.array(nodes[root[new]])})

    return run


class _Join:
    """One run of the join over one table."""

    def __init__(self, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> None:
        self.width, self.percent = width, percent
        text = text_of(docs, text_col)
        key = F.col(f"`{id_col}`").cast("long")
        place = F.coalesce(key, F.xxhash64(text)).alias("place")
        self.docs = docs.select(key.alias("id"), text.alias("text"), place, text_digest(text).alias("digest"))
        nodes = self.docs.mapInArrow(_nodes(width), "id long, place long, digest long, n long, node long, counts binary")
        self.nodes = materialise(nodes, "jaccard-nodes")
        self.vectors = self.nodes.select("node", "n", "counts", "place")

    def cells(self) -> DataFrame:
        """(first, node, met): nodes of a cell and its smallest node, with the number of such cells."""
        keys = self.docs.select("text").mapInArrow(_cells(self.width, self.percent), "key long, node long")
        named = keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_named, "first long, node long")
        members = materialise(named.groupBy("first", "node").agg(F.count("*").alias("met")), "jaccard-cells")
        del keys, named
        release_shuffles(self.docs.sparkSession)
        return members

    def points(self, nodes: DataFrame) -> DataFrame:
        """(node, n, counts, place) of some nodes: their points, and where a text of each is."""
        mine = self.vectors.join(nodes, "node", "left_semi").groupBy("node")
        return mine.agg(F.first("n").alias("n"), F.first("counts").alias("counts"), F.min("place").alias("place"))

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are linked: by the bound, by the bound over finer groups, then by the sets."""
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        points = materialise(self.points(nodes), "jaccard-points")
        a = points.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("counts").alias("counts_a"))
        b = points.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("counts").alias("counts_b"))
        near = pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "counts_a", "n_b", "counts_b")
        near = materialise(near.mapInArrow(_bounded(self.percent), "a long, b long, n_a long, n_b long"), "jaccard-near")
        sizes = near

        near = self._filtered(near, points, _fine_counts, _bounded_finely).join(sizes, ["a", "b"])
        return self._filtered(near, points, _sets, _verified)

    def _filtered(self, pairs: DataFrame, points: DataFrame, make, keep) -> DataFrame:
        """The pairs that ``keep`` keeps, by what ``make`` makes of a text of either node."""
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        # One exchange of the data of nodes serves both joins.
        data = self._data(points.join(nodes, "node", "left_semi"), make)
        of_a = data.select(F.col("node").alias("a"), F.col("data").alias("of_a"))
        of_b = data.select(F.col("node").alias("b"), F.col("data").alias("of_b"))
        both = pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "n_a", "n_b", "of_a", "of_b")
        found = materialise(both.mapInArrow(keep(self.percent), "a long, b long"), "jaccard-pairs")
        del data, of_a, of_b, both
        release_shuffles(self.docs.sparkSession)
        return found

    def _data(self, points: DataFrame, make) -> DataFrame:
        """(node, data) of some points: what ``make`` makes of a text of each."""
        places = checked_broadcast(points.select("place").distinct(), MAX_IDS)
        texts = self.docs.join(places, "place", "left_semi").select("text")
        return texts.mapInArrow(make(self.width), "node long, data binary").dropDuplicates(["node"])

    def star_pairs(self, stars: DataFrame, components: DataFrame) -> DataFrame:
        """Pairs of a node and the smallest node of its cells that are not of one component yet."""
        of_a = components.select(F.col("node").alias("a"), F.col("component").alias("in_a"))
        of_b = components.select(F.col("node").alias("b"), F.col("component").alias("in_b"))
        placed = stars.join(of_a, "a", "left").join(of_b, "b", "left")
        apart = placed.where(F.coalesce("in_a", "a") != F.coalesce("in_b", "b")).select("a", "b")
        return materialise(apart, "jaccard-apart")

    def open_links(self, members: DataFrame, components: DataFrame) -> DataFrame:
        """Links between nodes that meet under one name; the nodes that give the names are compared with all by now."""
        placed = members.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = placed.groupBy("first").agg(F.min("component").alias("least"), F.max("component").alias("most"))
        rows = materialise(placed.join(mixed.where("least != most").select("first"), "first"), "jaccard-mixed")
        points = materialise(self.points(rows.select("node").distinct()), "jaccard-points")
        sized = rows.join(points.select("node", "n"), "node").groupBy("first").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
        blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") / SET_SHINGLES)).cast("int")
        rows = rows.join(sized.select("first", blocks.alias("blocks")), "first")
        rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        # Two groups of one hash are one: that only compares more.
        shard = F.xxhash64("first", F.least("block", "other"), F.greatest("block", "other")).alias("shard")
        rows = rows.select(shard, (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "component")
        buckets = max(1, -(-rows.count() // BUCKET))
        finer = points.select("node", "n", "counts").join(self._data(points, _fine_counts), "node")
        bounded = rows.join(finer, "node").withColumn("bucket", F.pmod("shard", F.lit(buckets)))
        rows = bounded.groupBy("bucket").applyInArrow(_with_partners(self.percent), "shard long, side int, node long, component long")
        rows = materialise(self._dealt(materialise(rows, "jaccard-open"), points), "jaccard-dealt")
        release_shuffles(self.docs.sparkSession)
        return materialise(self._united(rows, points.select("node", "place")), "jaccard-links")

    def _dealt(self, rows: DataFrame, points: DataFrame) -> DataFrame:
        """Rows with their bucket: groups that share nodes go to one, so that a set is sent once, unless they are too many."""
        least = rows.groupBy("node").agg(F.min("shard").alias("least"))
        edges = rows.join(least, "node").where("shard != least").select(F.col("shard").alias("a"), F.col("least").alias("b")).distinct()
        families = connected_components(edges).select(F.col("node").alias("shard"), F.col("component").alias("family"))
        placed = rows.join(families, "shard", "left").withColumn("family", F.coalesce("family", "shard"))
        weights = placed.select("family", "node").distinct().join(points.select("node", "n"), "node")
        weights = materialise(weights.groupBy("family").agg(F.sum("n").alias("shingles")), "jaccard-families")
        buckets = max(1, -(-(weights.agg(F.sum("shingles")).first()[0] or 0) // SET_SHINGLES))
        whole = F.when(F.col("shingles") <= SET_SHINGLES, F.xxhash64("family")).otherwise(F.xxhash64("shard"))
        placed = placed.join(weights, "family").withColumn("bucket", F.pmod(whole, F.lit(buckets)))
        return placed.select("bucket", "shard", "side", "node", "component")

    def _united(self, rows: DataFrame, places: DataFrame) -> DataFrame:
        asked = rows.select("bucket", "node").distinct().join(places, "node")
        texts = self.docs.select("place", "text").join(checked_broadcast(materialise(asked, "jaccard-asked"), MAX_IDS), "place")
        sent = texts.select("text", "node", "bucket").mapInArrow(_sent(self.width), "to long, point long, size long, vector binary, data binary")
        return rows.groupBy("bucket").cogroup(sent.groupBy("to")).applyInArrow(_united(self.percent), "a long, b long")

    def components(self) -> DataFrame:
        """(node, component) of all nodes with a link."""
        members = self.cells()
        stars = members.select(F.col("node").alias("a"), F.col("first").alias("b"), "met")
        best = F.max_by("b", F.struct("met", "b")).alias("b")
        links = self.links(stars.groupBy("a").agg(best))
        components = connected_components(links)
        stars = self.star_pairs(stars.select("a", "b"), components)
        if not stars.isEmpty():
            links = links.unionByName(self.links(stars))
            components = connected_components(links)
        more = self.open_links(members.select("first", "node"), components)
        return components if more.isEmpty() else connected_components(links.unionByName(more))


def text_digest(text: Column) -> Column:
    return F.xxhash64(text, F.lit(1))


def link_components(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id) for every row: the size of its set and the smallest id linked with it.

    Texts are linked if their sets of ``width``-word shingles have at least ``percent`` per cent of their
    union in common; links are followed to the end.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be between 1 and 100")
    join = _Join(docs, width, percent, id_col, text_col)
    placed = join.nodes.select("id", "n", "node").join(join.components(), "node", "left")
    placed = placed.select("id", "n", F.coalesce("component", "node").alias("component"))
    smallest = placed.where("n > 0").groupBy("component").agg(F.min("id").alias("component_id"))
    linked = placed.join(smallest, "component", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return linked.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: one of its smallest id, the others go; rows without words all stay.

    Of rows that repeat, and of rows of one id and one text, one stays. Rows without an id come after all ids.
    """
    join = _Join(docs, width, percent, id_col, text_col)
    placed = join.nodes.where("n > 0").select("id", "digest", "node").join(join.components(), "node", "left")
    placed = placed.select("id", "digest", F.coalesce("component", "node").alias("component"))
    row = F.struct(F.col("id").isNull().alias("last"), "id", "digest")
    best = placed.groupBy("component").agg(F.min(row).alias("best"), F.count("*").alias("size")).where("size > 1")
    found = placed.join(materialise(best, "jaccard-best"), "component")
    key, is_best = [F.col("id").isNull().alias("last"), F.coalesce("id", F.lit(0)).alias("id"), "digest"], row == F.col("best")
    counted = found.groupBy(*key).agg(F.max(is_best).alias("stays"), F.count("*").alias("rows"))
    counted = materialise(counted.where(~F.col("stays") | (F.col("rows") > 1)), "jaccard-gone")
    number = F.col(f"`{id_col}`").cast("long")
    text = text_of(docs, text_col)
    keyed = docs.select(whole_row(docs), number.isNull().alias("last"), F.coalesce(number, F.lit(0)).alias("id"), text_digest(text).alias("digest"))
    names = ["last", "id", "digest"]
    kept = keyed.join(checked_broadcast(counted.select(*names), MAX_IDS), names, "left_anti")
    repeated = counted.where("stays").select(*names)
    if not repeated.isEmpty():
        one = keyed.join(checked_broadcast(repeated, MAX_IDS), names, "left_semi").dropDuplicates(names)
        kept = kept.unionByName(one)
    return unpack(kept.select(ROW), docs)
