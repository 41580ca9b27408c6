"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into ``CELLS`` equal cells. Every shard owns ``vnodes`` places
on it; a document falls into the cell of its id's hash, whose home is the first
virtual node clockwise. No shard takes more rows than its capacity: rows that
overflow it, in ring order, go on clockwise to the first virtual node of a shard
with room. With ``slack`` 0 the capacities sum to the number of rows, so that
counts differ by one at most; with more slack fewer rows leave their home.

The driver sees one count per cell, never a row: the number of cells is fixed.
It plans which ranks of a cell go to which shard. The rows are ranked cell by
cell in one shuffle of narrow rows and meet the plan, whose size is bounded by
cells, shards and virtual nodes, in a broadcast join.

Defined results: null text counts 0 bytes; rows with a null id are spread by the
digest of their text; repeated rows are told apart by rank only and each gets a
slot of its own; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELLS = 16_384
VNODES = 64
OVERHEAD_BYTES = 8


def _ring(shards: int, vnodes: int, cells: int) -> tuple[list[int], list[int]]:
    """Cells and shards of all virtual nodes in ring order."""
    places = []
    for shard in range(shards):
        for node in range(vnodes):
            digest = hashlib.sha256(f"shard {shard} node {node}".encode()).digest()
            places.append((int.from_bytes(digest[:8], "big") % cells, digest[8:16], shard))
    places.sort()
    return [p[0] for p in places], [p[2] for p in places]


def plan_ring(counts: dict[int, int], shards: int, vnodes: int = VNODES, slack: float = 0.0, cells: int = CELLS) -> list[tuple]:
    """(cell, from rank, to rank, home shard, shard, slot of the first rank) for all ranks of all cells.

    First each cell fills its home, in ring order; then the overflow of each
    cell goes on clockwise over the virtual nodes of shards that are not full.
    """
    total = sum(counts.values())
    if slack > 0:
        room = [-(-int(total * (1 + slack)) // shards) + 1] * shards
    else:
        room = [total // shards + (shard < total % shards) for shard in range(shards)]
    at, owner = _ring(shards, vnodes, cells)
    taken = [0] * shards
    plan, overflow = [], []

    def take(cell: int, low: int, amount: int, home: int, shard: int) -> int:
        got = min(amount, room[shard] - taken[shard])
        if got > 0:
            plan.append((cell, low, low + got, home, shard, taken[shard]))
            taken[shard] += got
        return got

    for cell in sorted(counts):
        node = bisect_left(at, cell) % len(at)
        got = take(cell, 0, counts[cell], owner[node], owner[node])
        if got < counts[cell]:
            overflow.append((cell, got, counts[cell] - got, owner[node]))
    alive = [i for i in range(len(at)) if taken[owner[i]] < room[owner[i]]]
    for cell, low, left, home in overflow:
        start = bisect_left(at, cell)
        while left:
            shard = owner[alive[bisect_left(alive, start) % len(alive)]]
            got = take(cell, low, left, home, shard)
            low, left = low + got, left - got
            if taken[shard] == room[shard]:
                alive = [i for i in alive if owner[i] != shard]
    return plan


def shard_documents(
    docs: DataFrame,
    shards: int,
    vnodes: int = VNODES,
    slack: float = 0.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    cells: int = CELLS,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot, home_shard) for every row; slots are gapless from 0 in each shard."""
    key, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    place = F.when(key.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key))
    cell = F.pmod(place, F.lit(cells)).cast("int").alias("cell")
    counts = {r["cell"]: r["count"] for r in docs.select(cell).groupBy("cell").count().collect()}
    plan = F.broadcast(
        docs.sparkSession.createDataFrame(
            plan_ring(counts, shards, vnodes, slack, cells),
            "cell int, low long, high long, home_shard int, shard int, first_slot long",
        )
    )
    rows = docs.select(
        key.alias(id_col),
        cell,
        place.alias("place"),
        (F.octet_length(text) + F.lit(OVERHEAD_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rank = F.row_number().over(W.partitionBy("cell").orderBy("place", id_col, "text_crc32", "size"))
    ranked = rows.withColumn("rank", (rank - 1).cast("long"))
    return ranked.join(plan, (ranked.cell == plan.cell) & (ranked.rank >= plan.low) & (ranked.rank < plan.high)).select(
        F.col(id_col),
        "size",
        "text_crc32",
        "shard",
        (F.col("first_slot") + F.col("rank") - F.col("low")).alias("slot"),
        "home_shard",
    )
