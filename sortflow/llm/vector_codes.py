"""Codes of vectors by product quantisation with exact integer rounds over Hilbert-sorted blocks.

Components become integers, vectors are cut into equal parts, and every part
position has its own codebook, which starts as the parts of the smallest ids and
is refined in rounds: every part goes to its nearest entry, every entry becomes
the floored mean of its parts.

The parts are sorted along a Hilbert curve once, and cut into flat blocks of at
most ``BLOCK`` parts. A block holds its parts as one integer matrix, with the box
from its smallest to its largest components, and its sums. In a round, the
distances from the box to an entry bound those of all its parts: entries whose
least distance exceeds the smallest of the largest distances are off the block's
shortlist. A block with one entry left is assigned by its sums, unread; else a
small integer kernel compares its parts with the shortlist. A task adds up its
blocks, so a round sends one row per entry and task; codebooks are as large as
asked for and go to the tasks as they are.

A vector of which a third of all rows are copies does no harm: places on the
curve are salted by the row, so equal parts may lie in many blocks.

Defined results: rows whose vector is null or holds null or non-finite components
are left out; the start takes the smallest ids, equal ids by their vectors, rows
without an id last; vectors shorter than the longest are filled with zeros, as is the
last part if parts are unequal; with fewer rows than entries there are as many entries as rows;
equal distances go to the lower index; an entry that no part goes to stays;
repeated rows count as often as they come; an empty table gives no rows. Components
beyond 31 bits, or squared distances beyond 62, raise an error. Columns other than
id, vector and label are not read; without a label column all labels are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortflow.plans.broadcasting import checked_broadcast
from sortflow.plans.workspace import materialise

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024.0
BLOCK = 512
#: Bits of a component on the Hilbert curve.
CURVE_BITS = 4
#: Rows of labels' sums for each label, if there are too many labels to broadcast.
SALTS = 16
#: Up to here every integer is a float of its own, so that the kernel may use floats.
_EXACT = 1 << 53
_LARGEST = 1 << 62

_BLOCKS = "part int, rows binary, low binary, high binary, sums binary, parts binary"


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Place on the Hilbert curve of every row of ``cells`` (numbers below ``2 ** bits``), as bytes in sorted order."""
    x = cells.astype(np.uint32).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    fold = np.zeros(x.shape[1], np.uint32)
    q = 1 << (bits - 1)
    while q > 1:
        fold ^= np.where((x[-1] & q) != 0, q - 1, 0).astype(np.uint32)
        q >>= 1
    x ^= fold
    planes = [(x[i] >> bit) & 1 for bit in range(bits - 1, -1, -1) for i in range(dims)]
    packed = np.packbits(np.stack(planes, axis=1).astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer rows of one width; shorter ones are filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _longs(data, width: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, width)


@dataclass(frozen=True)
class Grid:
    """Where the cells of the curve lie: it decides which parts share a block, never a code."""

    low: np.ndarray
    step: np.ndarray

    @staticmethod
    def around(vectors: np.ndarray, bits: int) -> Grid:
        middle, spread = vectors.mean(axis=0), np.maximum(vectors.std(axis=0), 1.0)
        return Grid(middle - 2.5 * spread, 5 * spread / (1 << bits))

    def cells(self, vectors: np.ndarray, bits: int) -> np.ndarray:
        return np.clip((vectors - self.low) // self.step, 0, (1 << bits) - 1)


def squared_distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points and entries."""
    reach = int(np.abs(points).max(initial=0)) + int(np.abs(entries).max(initial=0))
    if reach * reach * points.shape[1] >= _LARGEST:
        raise OverflowError("Squared distances do not fit 64 bits")
    if reach * reach * points.shape[1] < _EXACT:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ e.T) + (e * e).sum(axis=1)).astype(np.int64)
    return np.stack([((points - entry) ** 2).sum(axis=1) for entry in entries], axis=1)


def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Indexes, ascending, of the entries that can be nearest to, or tie for, a point of the box."""
    outside = np.maximum(np.maximum(low - entries, entries - high), 0)
    farthest = np.maximum(np.abs(entries - low), np.abs(entries - high))
    reach = int(np.abs(farthest).max(initial=0))
    if reach * reach * entries.shape[1] >= _LARGEST:
        raise OverflowError("Squared distances do not fit 64 bits")
    least, most = (outside**2).sum(axis=1), (farthest**2).sum(axis=1)
    return np.flatnonzero(least <= most.min())


def nearest(points: np.ndarray, low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of every point of a box; ties go to the lower index."""
    near = shortlist(low, high, entries)
    apart = squared_distances(points, entries[near])
    best = apart.argmin(axis=1)
    return near[best], apart[np.arange(len(points)), best]


def _placed(parts: int, width: int, grid: Grid, bits: int):
    """One row per part: its position, its place on the curve, the number of its vector and its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(1), width * parts)
            cells = grid.cells(vectors, bits)
            for part in range(parts):
                mine = slice(part * width, (part + 1) * width)
                keys = pa.array(hilbert_keys(cells[:, mine], bits), pa.binary())
                data = pa.array([v.tobytes() for v in np.ascontiguousarray(vectors[:, mine])], pa.binary())
                number = pa.array(np.full(len(vectors), part, np.int32))
                yield pa.RecordBatch.from_arrays([number, keys, batch.column(0), data], ["part", "place", "row", "data"])

    return run


def _in_blocks(width: int):
    """Flat blocks of parts that come sorted by position and place."""

    def block(part: int, rows: list[int], data: list[bytes]) -> pa.RecordBatch:
        points = _longs(b"".join(data), width)
        low, high, sums = points.min(axis=0), points.max(axis=0), points.sum(axis=0)
        stored = [x.tobytes() for x in (np.array(rows, np.int64), low, high, sums, points)]
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), *[pa.array([x], pa.binary()) for x in stored]],
            [c.split()[0] for c in _BLOCKS.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, data = -1, [], []
        for batch in batches:
            for p, r, d in zip(*(batch.column(c).to_pylist() for c in ("part", "row", "data"))):
                if rows and (p != part or len(rows) == BLOCK):
                    yield block(part, rows, data)
                    rows, data = [], []
                part = p
                rows.append(r)
                data.append(d)
        if rows:
            yield block(part, rows, data)

    return run


def _blocks_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(part, [rows, low, high, sums, parts]) of every block, without copies."""
    parts = batch.column(0).to_pylist()
    for k, part in enumerate(parts):
        rows, *stored = (_longs(batch.column(c)[k].as_buffer(), 1 if c == 1 else width) for c in range(1, batch.num_columns))
        yield part, [rows.ravel(), *stored]


class Totals:
    """Counts and sums of the parts that go to each entry."""

    def __init__(self, codebooks: np.ndarray) -> None:
        self.counts = np.zeros(codebooks.shape[:2], np.int64)
        self.sums = np.zeros(codebooks.shape, np.int64)

    def add(self, part: int, index: np.ndarray, points: np.ndarray) -> None:
        order = np.argsort(index, kind="stable")
        used, first = np.unique(index[order], return_index=True)
        self.counts[part, used] += np.diff(np.append(first, len(index)))
        self.sums[part, used] += np.add.reduceat(points[order], first, axis=0)

    def add_block(self, part: int, index: int, size: int, sums: np.ndarray) -> None:
        self.counts[part, index] += size
        self.sums[part, index] += sums


def _round(codebooks: np.ndarray):
    """Counts and sums per entry of all blocks of a task; blocks with one possible entry are taken by their sums."""
    width = codebooks.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = Totals(codebooks)
        for batch in batches:
            for part, (rows, low, high, sums, points) in _blocks_of(batch, width):
                near = shortlist(low[0], high[0], codebooks[part])
                if len(near) == 1:
                    totals.add_block(part, near[0], len(rows), sums[0])
                else:
                    totals.add(part, near[squared_distances(points, codebooks[part, near]).argmin(axis=1)], points)
        part, entry = np.nonzero(totals.counts)
        sums = totals.sums[part, entry]
        columns = [part, entry, totals.counts[part, entry], *sums.T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "entry", "n", *_components(width)])

    return run


def _components(width: int) -> list[str]:
    return [f"s{i}" for i in range(width)]


def _coded(codebooks: np.ndarray):
    """(row, part, code, error) of every part."""
    width = codebooks.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, (rows, low, high, _, points) in _blocks_of(batch, width):
                index, error = nearest(points, low[0], high[0], codebooks[part])
                columns = rows, np.full(len(rows), part), index, error
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["row", "part", "code", "error"])

    return run


class VectorCodes:
    """A product quantiser fitted on a whole table, and the codes of its rows."""

    def __init__(
        self,
        vectors: DataFrame,
        parts: int = PARTS,
        entries: int = ENTRIES,
        rounds: int = ROUNDS,
        scale: float = SCALE,
        id_col: str = "vec_id",
        vector_col: str = "embedding",
        label_col: str = "label",
    ) -> None:
        """Entries beyond 256 take more than two digits of a code."""
        self.names = id_col, label_col
        self.parts, self.digits = parts, max(2, len(f"{max(0, entries - 1):x}"))
        spark = vectors.sparkSession
        # Numbered and written once: the number is how the parts of a row find each other.
        self.rows = materialise(_integers(vectors, id_col, vector_col, label_col, scale), "codes-rows")
        self.width = max(1, -(-(self.rows.agg(F.max(F.size("v"))).first()[0] or 0) // parts))
        first = self.rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").toArrow()
        start = _matrix(first.column("v").combine_chunks(), self.width * parts)
        self.codebooks = start.reshape(len(start), parts, self.width).swapaxes(0, 1).copy()
        self.empty = not len(start)
        if not self.empty:
            self.blocks = self._sorted_blocks(start, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
            for _ in range(rounds):
                self._refine()

    def _sorted_blocks(self, start: np.ndarray, partitions: int) -> DataFrame:
        grid = Grid.around(start.astype(np.float64), CURVE_BITS)
        numbered = self.rows.select("row", "v")
        placed = numbered.mapInArrow(_placed(self.parts, self.width, grid, CURVE_BITS), "part int, place binary, row long, data binary")
        spread = placed.withColumn("salt", F.xxhash64("row")).repartitionByRange(partitions, "part", "place", "salt")
        blocks = spread.sortWithinPartitions("part", "place", "salt").select("part", "row", "data").mapInArrow(_in_blocks(self.width), _BLOCKS)
        return materialise(blocks, "codes-blocks")

    def _refine(self) -> None:
        columns = _components(self.width)
        schema = "part long, entry long, n long, " + ", ".join(f"{c} long" for c in columns)
        totals = self.blocks.mapInArrow(_round(self.codebooks), schema)
        # At most parts x entries rows.
        totals = totals.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *columns)]).toArrow()
        part, entry, n, *sums = (totals.column(c).to_numpy() for c in totals.column_names)
        if len(n):
            refined = self.codebooks.copy()
            refined[part, entry] = np.stack(sums, axis=1) // n[:, None]
            self.codebooks = refined

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()

    def codes(self) -> DataFrame:
        """(id, label, code, error) of every row; the code has two hexadecimal digits a part."""
        rows = self.rows.select("row", "id", "label")
        if self.empty:
            return rows.where("false").select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        coded = self.blocks.mapInArrow(_coded(self.codebooks), "row long, part long, code long, error long")
        digits = F.lower(F.lpad(F.hex("code"), self.digits, "0"))
        said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", digits.alias("digits")))), lambda x: x["digits"]), "")
        whole = coded.groupBy("row").agg(said.alias("code"), F.sum("error").alias("error"))
        return rows.join(whole, "row").select("id", "label", "code", "error")


def _integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: float) -> DataFrame:
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    label = F.col(f"`{label_col}`") if label_col in vectors.columns else F.lit(None).cast("int")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.alias("label"), vector.alias("v"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("v").isNotNull() & usable)
    beyond = F.raise_error(F.lit("A component does not fit 31 bits")).cast("long")
    whole = F.transform("v", lambda x: F.when(F.abs(x * scale) < 1 << 31, F.floor(x * scale)).otherwise(beyond))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", whole.alias("v"))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with the errors summed over rows of one label, nulls together."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    same = F.col("label").eqNullSafe(F.col("of_label"))
    near = checked_broadcast(sums)
    if near is not sums:
        return coded.join(near, same).drop("of_label")
    # Too many labels to send to every task: each label's sum is there several times, its rows are dealt to them.
    salted = sums.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, same & (F.col("salt") == F.col("of_salt"))).drop("of_label", "of_salt", "salt")


def vector_codes(vectors: DataFrame, **options) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) of every usable row of ``vectors``; see ``VectorCodes``."""
    fitted = VectorCodes(vectors, **options)
    coded = with_label_errors(materialise(fitted.codes(), "codes"))
    id_name, label_name = fitted.names
    return coded.select(
        F.col("id").alias(id_name),
        F.col("label").alias(label_name),
        "code",
        "error",
        "label_error",
        F.lit(fitted.digest()).alias("codebooks_sha256"),
    )
