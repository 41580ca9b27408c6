"""Where files go: ``<out>/<category>/<name>``, with ``_1``, ``_2``, ... where the name is taken.

The sequential rule is: each file, in order, takes its own name if free, else
the first free ``stem_k.suffix``. Names of one folder form a tree: ``a_3.txt``
is slot 3 of ``a.txt``. Files of one name fill its slots in order, and skip
slots that are taken: by an existing file, or by a file that came under that
very name before. So a file's slot follows from its position among the files
of its name, which a chunked scan gives, and from the skipped slots before it.

Which slots are skipped is a scan as well. Let y be the slots that a name has skipped
so far, its own included if that is gone. A run of slots on disk adds its length to y. A slot ``s`` that is
also a name coming in, for the first time after ``b`` files of the parent, is
skipped if y is at most ``s - b``, and else taken by a file of the parent. So a chunk of
slots is a function of y, ``y + added + (how many of some thresholds are y or more)``, whatever
comes before it. Chunks work out their thresholds in parallel; one pass over the
summaries of a name, which holds one chunk's at a time, gives every chunk the y it starts with; and chunks are
walked in parallel again. A name starts with y = 1 if its own slot is gone, else
with 0. Both are walked, and which one holds is found by pointer jumping up the tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortflow.functions.paths import extension, stem
from sortflow.plans.scan import CHUNK, CHUNK_ROWS, Running, dense_index, id_chunk, running
from sortflow.plans.workspace import materialise

_NAME = ("category", "parent")
_NO_LIMIT = 1 << 62
_COUNTER = r"(?s)^(.+)_([1-9][0-9]*)\z"


def _suffix(name: Column) -> Column:
    ext = extension(name)
    return F.when(ext != "", F.concat(F.lit("."), ext)).otherwise("")


def numbered_name(name: Column, slot: Column) -> Column:
    """The name of a slot; slot 0 is the name itself."""
    numbered = F.concat(stem(name), F.lit("_"), slot.cast("string"), _suffix(name))
    return F.when(slot == 0, name).otherwise(numbered)


def _slots_in_use(incoming: DataFrame, on_disk: DataFrame) -> DataFrame:
    """(category, parent, slot, name, first, exists): names in use that are a slot of an incoming name.

    ``first`` is when a name first comes in, null for one that is on disk only.
    """
    names = incoming.join(on_disk, ["category", "name"], "full")
    counter = F.regexp_extract(stem(F.col("name")), _COUNTER, 2)
    base = F.regexp_extract(stem(F.col("name")), _COUNTER, 1)
    children = names.where(counter != "").select(
        "category",
        "name",
        "first",
        F.coalesce("exists", F.lit(False)).alias("exists"),
        F.concat(base, _suffix(F.col("name"))).alias("parent"),
        counter.try_cast("bigint").alias("slot"),
    )
    parents = incoming.select("category", F.col("name").alias("parent"), F.col("n").alias("parent_n"))
    return children.where("slot is not null").join(parents, ["category", "parent"])


def _touching(slots: DataFrame) -> DataFrame:
    """What one family has to be solved over: runs of slots on disk, and claims within reach.

    Neighbouring slots on disk are always passed together, so a run of them is
    one row, however long. A claim matters only if its parent could get there:
    it passes at most the slots in use below, and has one slot per file.
    """
    placed = dense_index(slots, ["category", "parent"], ["slot"], F.floor(F.col("slot") / CHUNK_ROWS), "__below")
    on_disk = placed.where("exists")
    indexed = dense_index(
        on_disk, ["category", "parent"], ["slot"], F.floor(F.col("slot") / CHUNK_ROWS), "__place"
    )
    runs = indexed.groupBy("category", "parent", (F.col("slot") - F.col("__place")).alias("__run")).agg(
        F.min("slot").alias("slot"), F.count("*").alias("length")
    )
    claims = placed.where("not exists and slot - 1 - __below < parent_n").select(
        "category", "parent", "slot", "name", "first", F.lit(1).cast("bigint").alias("length")
    )
    return runs.drop("__run").unionByName(claims, allowMissingColumns=True)


def thresholds(lengths: np.ndarray, limits: np.ndarray) -> tuple[int, list[int]]:
    """(added, sorted thresholds) of slots in order: y becomes ``y + added + (thresholds that are y or more)``.

    A slot with a limit adds 1 to a y of at most the limit; others add their length.
    """
    added, found = 0, []
    for length, limit in zip(lengths.tolist(), limits.tolist()):
        if limit == _NO_LIMIT:
            added += length
            continue
        # The largest y that arrives here as the limit: behind it, y passes by.
        goal, low, high = limit - added, 0, len(found)
        while low < high:
            middle = (low + high) // 2
            if found[middle] + len(found) - middle <= goal:
                low = middle + 1
            else:
                high = middle
        found.insert(low, goal - (len(found) - low))
    return added, found


def _sorted_by_slot(table: pa.Table) -> tuple[np.ndarray, ...]:
    table = table.sort_by("slot")
    return tuple(table.column(c).to_numpy() for c in ("slot", "length", "limit"))


def _summarised(key: tuple, table: pa.Table) -> pa.Table:
    """One row for a chunk of a name's slots."""
    _, lengths, limits = _sorted_by_slot(table)
    added, found = thresholds(lengths, limits)
    columns = {c: [k.as_py()] for c, k in zip((*_NAME, CHUNK), key)}
    return pa.table({**columns, "added": [added], "thresholds": pa.array([found], pa.list_(pa.int64()))})


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The y with which every chunk starts, for a name that starts with 0 and with 1; rows come sorted by name and chunk."""
    name, starts = None, [0, 1]
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*_NAME, CHUNK, "added")]
        out: list[list] = [[], [], [], [], []]
        for i, (category, parent, chunk, added) in enumerate(zip(*columns)):
            if (category, parent) != name:
                name, starts = (category, parent), [0, 1]
            for column, value in zip(out, (category, parent, chunk, *starts)):
                column.append(value)
            found = batch.column("thresholds")[i].values.to_numpy(zero_copy_only=False)
            starts = [y + added + len(found) - int(np.searchsorted(found, y)) for y in starts]
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [*_NAME, CHUNK, "y_0", "y_1"])


def _walked(table: pa.Table) -> pa.Table:
    """For both starts: y before each slot, and whether the slot is skipped."""
    table = table.sort_by("slot")
    lengths, limits = (table.column(c).to_numpy() for c in ("length", "limit"))
    out = {}
    for start in (0, 1):
        y, before, skipped = int(table.column(f"y_{start}")[0].as_py()), [], []
        for length, limit in zip(lengths.tolist(), limits.tolist()):
            skips = y <= limit
            before.append(y)
            skipped.append(skips)
            y += length * skips
        out |= {f"before_{start}": pa.array(before, pa.int64()), f"skipped_{start}": pa.array(skipped, pa.bool_())}
    kept = {c: table.column(c) for c in (*_NAME, "slot", "length", "name")}
    return pa.table({**kept, **out})


def _walk(slots: DataFrame) -> DataFrame:
    """(category, parent, slot, length, name, before_0, skipped_0, before_1, skipped_1) of all touching slots of all names."""
    placed = dense_index(slots, list(_NAME), ["slot"], F.floor(F.col("slot") / CHUNK_ROWS), "__place")
    placed = placed.withColumn(CHUNK, F.floor(F.col("__place") / CHUNK_ROWS)).drop("__place")
    placed = materialise(placed.select(*_NAME, CHUNK, "slot", "length", "limit", "name"), "slot-chunks")
    keys = f"category string, parent string, {CHUNK} long"
    summaries = placed.select(*_NAME, CHUNK, "slot", "length", "limit").groupBy(*_NAME, CHUNK)
    summaries = summaries.applyInArrow(_summarised, f"{keys}, added long, thresholds array<long>")
    ordered = summaries.repartition(*_NAME).sortWithinPartitions(*_NAME, CHUNK)
    starts = materialise(ordered.mapInArrow(_carried, f"{keys}, y_0 long, y_1 long"), "slot-starts")
    walks = placed.join(starts, [*_NAME, CHUNK]).groupBy(*_NAME, CHUNK)
    schema = "category string, parent string, slot long, length long, name string, "
    return walks.applyInArrow(_walked, schema + "before_0 long, skipped_0 boolean, before_1 long, skipped_1 boolean")


def _gone(walked: DataFrame, own: DataFrame) -> DataFrame:
    """(category, name): names whose own slot is gone, on disk or to a file of their parent.

    Whether a name's slot goes to its parent depends on whether the parent's is gone: two
    answers per name, which are composed with those of the parent, its parent's parent, and so on, doubling.
    """
    claims = walked.where("name is not null").select(
        "category", "name", F.col("parent").alias("up"), (~F.col("skipped_0")).alias("if_0"), (~F.col("skipped_1")).alias("if_1")
    )
    on_disk = own.select("category", "name", F.lit(None).cast("string").alias("up"), F.lit(True).alias("if_0"), F.lit(True).alias("if_1"))
    # A name on disk is gone, whatever its parent does.
    rows = materialise(claims.join(own, ["category", "name"], "left_anti").unionByName(on_disk), "name-answers")
    while not rows.where("up is not null").isEmpty():
        above = rows.select("category", F.col("name").alias("up"), F.col("up").alias("next"), F.col("if_0").alias("of_0"), F.col("if_1").alias("of_1"))
        joined = rows.join(above, ["category", "up"], "left")
        answer = lambda x: F.when(F.coalesce(x, F.lit(False)), F.col("if_1")).otherwise(F.col("if_0"))
        joined = joined.select("category", "name", F.col("next").alias("up"), answer(F.col("of_0")).alias("if_0"), answer(F.col("of_1")).alias("if_1"))
        rows = materialise(joined, "name-answers")
    return rows.where("if_0").select("category", "name")


def _passed(touching: DataFrame, befores: DataFrame) -> DataFrame:
    """(category, name, position, passed): slots passed over by the files of a name from a position on; -1 is its own slot."""
    runs = touching.where("first is null and slot > 0").select(*_NAME, "slot", "length", F.lit(_NO_LIMIT).alias("limit"), F.lit(None).cast("string").alias("name"))
    claims = befores.select(*_NAME, "slot", F.lit(1).cast("bigint").alias("length"), (F.col("slot") - F.col("before")).alias("limit"), "name")
    own = touching.where("slot = 0").select("category", "name")
    walked = materialise(_walk(runs.unionByName(claims)), "walked-slots")
    gone = materialise(_gone(walked, own), "gone-names")
    started = walked.drop("name").withColumnRenamed("parent", "name").join(gone.withColumn("gone", F.lit(True)), ["category", "name"], "left")
    of = lambda c: F.when(F.col("gone"), F.col(f"{c}_1")).otherwise(F.col(f"{c}_0"))
    skipped = started.where(of("skipped")).select("category", "name", (F.col("slot") - of("before")).alias("position"), F.col("length").alias("passed"))
    return skipped.unionByName(gone.select("category", "name", F.lit(-1).cast("bigint").alias("position"), F.lit(1).cast("bigint").alias("passed")))


def _with_destination(df: DataFrame, slot: Column, out_root: str) -> DataFrame:
    name = numbered_name(F.col("name"), slot)
    return df.withColumn("destination", F.concat_ws("/", F.lit(out_root), F.col("category"), name))


def plan_destinations(files: DataFrame, out_root: str, existing: DataFrame | None = None) -> DataFrame:
    """Add ``destination`` to (seq, category, name, ...). ``seq`` is a unique integer: the order of arrival.

    ``files`` is read several times and should be a stored table, not the end of a costly plan.

    ``existing`` has (category, name) of files already in place. Names that end
    in a dot are numbered by the same rule, but are not seen as slots of one another.
    """
    if existing is None:
        existing = files.sparkSession.createDataFrame([], "category string, name string")
    keys = ["category", "name"]
    incoming = files.groupBy(*keys).agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    on_disk = existing.select(*keys).distinct().withColumn("exists", F.lit(True))
    own = incoming.join(on_disk, keys, "left_semi").select(*keys, F.lit(0).cast("bigint").alias("slot"))
    touching = _touching(_slots_in_use(incoming, on_disk)).unionByName(own, allowMissingColumns=True)
    touching = materialise(touching, "touching-names")
    if touching.isEmpty():
        placed = dense_index(files, keys, ["seq"], id_chunk("seq"), "__position")
        return _with_destination(placed, F.col("__position"), out_root).select(*files.columns, "destination")

    # Positions of the files, and of the first claims on their slots, among the files of a name.
    claims = touching.where("first is not null").select(
        "category",
        F.col("parent").alias("name"),
        F.col("first").alias("seq"),
        F.lit(0).alias("__arrival"),
        F.col("name").alias("__claim"),
        F.col("slot").alias("__slot"),
    )
    placed = running(
        files.withColumn("__arrival", F.lit(1)).unionByName(claims, allowMissingColumns=True),
        keys,
        ["seq"],
        id_chunk("seq"),
        Running("__position", "sum", F.col("__arrival").cast("bigint"), inclusive=False),
    )
    placed = materialise(placed, "placed-files")
    befores = placed.where("__arrival = 0").select(
        "category",
        F.col("name").alias("parent"),
        F.col("__claim").alias("name"),
        F.col("__slot").alias("slot"),
        F.col("__position").alias("before"),
    )
    solved = materialise(_passed(touching, befores), "passed-slots")
    # Position -1 marks a name whose own slot is gone: one more slot to pass for all its files.
    passed = (
        solved.groupBy(*keys, F.greatest("position", F.lit(0)).alias("__position"))
        .agg(F.sum("passed").alias("__passed"))
        .withColumn("__arrival", F.lit(0))
    )
    arrived = placed.where("__arrival = 1").drop("__claim", "__slot").withColumn("__passed", F.lit(0).cast("bigint"))
    numbered = running(
        arrived.unionByName(passed, allowMissingColumns=True),
        keys,
        ["__position", "__arrival"],
        F.floor(F.col("__position") / CHUNK_ROWS),
        Running("__skipped", "sum", F.col("__passed")),
    )
    slot = F.col("__position") + F.col("__skipped")
    return _with_destination(numbered.where("__arrival = 1"), slot, out_root).select(*files.columns, "destination")
