"""The move log: routing status, appends, undo replay and the views over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sortflow.functions.paths import base_name
from sortflow.functions.text import percent_text
from sortflow.functions.vocabulary import CATEGORIES, REJECT_THRESHOLD
from sortflow.plans.broadcasting import dimension
from sortflow.plans.scan import CHUNK, CHUNK_ROWS, carry_join, chunked, dense_index, id_chunk, next_value
from sortflow.plans.workspace import delete_folder, folder_names, materialise, scratch_scope

MOVE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("src", T.StringType()),
        T.StructField("dst", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("undone", T.IntegerType()),
    ]
)

RECENT_LIMIT = 50
FEED_LIMIT = 100


# --- routing and appends ----------------------------------------------------------------------------


def route_status(
    confidence: Column, auto_move: Column, failed: Column, threshold: float = REJECT_THRESHOLD
) -> Column:
    """Pending without auto-move; else skipped below the threshold, an error if the move failed, or moved.

    The confidence compared is the rounded one of the record.
    """
    return (
        F.when(~auto_move, "Pending")
        .when(confidence < threshold, f"Skipped (< {threshold:.2f})")
        .when(failed, "Error")
        .otherwise("Moved")
    )


def apply_all_pending(
    df: DataFrame, threshold: float = REJECT_THRESHOLD, failed: Column | None = None
) -> DataFrame:
    """Route every Pending row now; rows skipped before carry another status and are not retried."""
    routed = route_status(F.col("confidence"), F.lit(True), F.lit(False) if failed is None else failed, threshold)
    return df.withColumn("status", F.when(F.col("status") == "Pending", routed).otherwise(F.col("status")))


#: What is stored: moves and undos of every owner, in the order of their ids.
LOG_SCHEMA = T.StructType(
    [*MOVE_SCHEMA.fields, T.StructField("op", T.StringType()), T.StructField("owner", T.StringType())]
)
ONE_OWNER = ""


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The stored operations with their ``batch`` column, empty if nothing was ever written."""
    schema = T.StructType([*LOG_SCHEMA.fields, T.StructField("batch", T.StringType())])
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def replayed(log: DataFrame) -> DataFrame:
    """The moves of stored operations, ``undone`` set by the undos on record."""
    ops = log.withColumns({"op": F.coalesce("op", F.lit("move")), "owner": F.coalesce("owner", F.lit(ONE_OWNER))})
    if ops.where("op = 'undo'").isEmpty():
        return ops.where("op = 'move'")
    return undo_replay(ops.drop("undone"))


def read_moves(spark: SparkSession, path: str) -> DataFrame:
    return replayed(read_log(spark, path)).select(*MOVE_SCHEMA.names)


def append_operations(path: str, rows: DataFrame, order: str, batch: str) -> None:
    """Append (op, owner, src, dst, category, confidence[, ts]) rows in ``order``, a unique integer column.

    Ids go on after the highest one on record. A batch is a folder of its own
    that a replay overwrites, so writing a batch twice leaves it once; a batch
    that is in the snapshot already is left as it is. One writer at a time, as ids are taken from the log.
    Only the snapshot's last id and the batches since are read.
    """
    taken = snapshot(rows.sparkSession, path)
    if batch in taken.batches:
        return
    last = max(taken.last, _since(rows.sparkSession, path, taken, batch).agg(F.max("id")).first()[0] or 0)
    placed = dense_index(rows, [], [order], id_chunk(order), "__row")
    ts = F.col("ts") if "ts" in rows.columns else F.current_timestamp()
    stored = placed.select(
        (F.lit(last) + 1 + F.col("__row")).cast("bigint").alias("id"),
        "src",
        "dst",
        "category",
        F.col("confidence").cast("double").alias("confidence"),
        ts.cast("timestamp").alias("ts"),
        F.lit(0).alias("undone"),
        "op",
        F.col("owner").cast("string").alias("owner"),
    )
    stored.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def append_moves(path: str, moves: DataFrame, order: str, batch: str) -> None:
    """Append moves; without an ``owner`` column they are all of one owner."""
    owner = F.col("owner") if "owner" in moves.columns else F.lit(ONE_OWNER)
    append_operations(path, moves.withColumns({"op": F.lit("move"), "owner": owner}), order, batch)


def append_undo(spark: SparkSession, path: str, batch: str, owner: str = ONE_OWNER) -> None:
    """Append one undo of the owner's newest live move; it does nothing if there is none."""
    columns = "n long, op string, owner string, src string, dst string, category string, confidence double"
    undo = spark.createDataFrame([(0, "undo", owner, None, None, None, None)], columns)
    append_operations(path, undo, "n", batch)


# --- snapshots of the log ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Snapshot:
    """What the folded batches of a log left: their live moves, which are the open stack of every owner, and the last id."""

    version: int
    moves: DataFrame
    batches: frozenset[str]
    last: int


def snapshot(spark: SparkSession, path: str) -> Snapshot:
    """The newest whole snapshot beside the log at ``path``; an empty one if nothing was ever folded.

    A snapshot counts once its list of batches is written, which comes last. The driver reads that list, a name
    per batch, as it lists the folders of the batches; it reads no moves.
    """
    root = f"{path}-live"
    for version in sorted((int(v.removeprefix("version=")) for v in folder_names(spark, root)), reverse=True):
        folder = f"{root}/version={version}"
        if any(f.endswith(".parquet") for f in folder_names(spark, f"{folder}/folded")):
            folded = spark.read.schema("batch string, last long").parquet(f"{folder}/folded").collect()
            moves = spark.read.schema(LOG_SCHEMA).parquet(f"{folder}/moves")
            return Snapshot(version, moves, frozenset(r.batch for r in folded), max(r["last"] for r in folded))
    return Snapshot(-1, spark.createDataFrame([], LOG_SCHEMA), frozenset(), 0)


def _batches_since(spark: SparkSession, path: str, taken: Snapshot, but: str | None = None) -> list[str]:
    names = [n.removeprefix("batch=") for n in folder_names(spark, path) if n.startswith("batch=")]
    return [n for n in names if n not in taken.batches and n != but]


def _since(spark: SparkSession, path: str, taken: Snapshot, but: str | None = None) -> DataFrame:
    """The operations that came after the snapshot; only their folders are opened."""
    folders = [f"{path}/batch={n}" for n in _batches_since(spark, path, taken, but)]
    ops = spark.read.schema(LOG_SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], LOG_SCHEMA)
    return ops.withColumns({"op": F.coalesce("op", F.lit("move")), "owner": F.coalesce("owner", F.lit(ONE_OWNER))})


def live_moves(spark: SparkSession, path: str, but: str | None = None) -> DataFrame:
    """The stored moves that no undo took back, leaving out the batch ``but`` if it is not folded.

    The operations since the snapshot come down to moves that stayed and undos that reach below; those take
    the newest moves of the snapshot. Nothing that was undone before the snapshot is read again.
    """
    taken = snapshot(spark, path)
    since = _since(spark, path, taken, but)
    if since.where("op = 'undo'").isEmpty():
        return taken.moves.unionByName(since.where("op = 'move'"))
    stayed, reach = net_effect(since.drop("undone"))
    gone = newest_moves(taken.moves, reach).select("id")
    stayed = stayed.withColumns({"op": F.lit("move"), "undone": F.lit(0)})
    return taken.moves.join(gone, "id", "left_anti").unionByName(stayed.select(*LOG_SCHEMA.names))


def fold_log(spark: SparkSession, path: str, least: int = 1) -> bool:
    """Write a new snapshot if at least ``least`` batches came since the last one; says whether it did.

    The log itself stays as it is, for the views over all moves. The snapshot before the last is deleted: a reader
    may still be at the last one. A fold that was cut off is written again by the next.
    """
    taken = snapshot(spark, path)
    names = _batches_since(spark, path, taken)
    if len(names) < max(1, least):
        return False
    folder = f"{path}-live/version={taken.version + 1}"
    with scratch_scope(spark):
        last = max(taken.last, _since(spark, path, taken).agg(F.max("id")).first()[0] or 0)
        live_moves(spark, path).write.mode("overwrite").parquet(f"{folder}/moves")
    folded = spark.createDataFrame([(n, last) for n in sorted({*taken.batches, *names})], "batch string, last long")
    folded.coalesce(1).write.mode("overwrite").parquet(f"{folder}/folded")
    if taken.version > 0:
        delete_folder(spark, f"{path}-live/version={taken.version - 1}")
    return True


def net_effect(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Operations as (moves that no undo among them took back; per owner, how many undos ``reach`` below them)."""
    stayed = materialise(undo_replay(ops).where("undone = 0").drop("undone"), "moves-stayed")
    undos = ops.where("op = 'undo'").groupBy("owner").agg(F.count("*").alias("undos"))
    moves = ops.where("op = 'move'").groupBy("owner").agg(F.count("*").alias("moves"))
    left = stayed.groupBy("owner").agg(F.count("*").alias("stayed"))
    # A move that did not stay took one undo; the others reach below.
    counts = undos.join(moves, "owner", "left").join(left, "owner", "left").fillna(0, ["moves", "stayed"])
    return stayed, counts.select("owner", (F.col("undos") - F.col("moves") + F.col("stayed")).alias("reach")).where("reach > 0")


def newest_moves(moves: DataFrame, reach: DataFrame) -> DataFrame:
    """The ``reach`` newest of every owner's live moves, counted by chunks of ids, so that no owner is one task."""
    rows = moves.join(reach, "owner").withColumn("__age", -F.col("id"))
    ranked = dense_index(rows, ["owner"], ["__age"], F.floor(F.col("__age") / CHUNK_ROWS), "__rank")
    return ranked.where("__rank < reach").select(*moves.columns)


# --- undo -------------------------------------------------------------------------------------------


def undo_replay(
    ops: DataFrame, owner: str = "owner", id_col: str = "id", op: str = "op"
) -> DataFrame:
    """Add ``undone`` to the moves of an operation log of 'move' and 'undo' rows.

    Each undo cancels the newest live move of its owner; on an empty log it
    does nothing. Undos that failed are any other value of ``op`` and are
    ignored. This is bracket matching: a move's level is the stack depth it
    makes, an undo's level the depth it finds, and a move is undone if the
    next row of its level is an undo. Depths come from a chunked scan, so an
    owner of any size is spread over many tasks. ``id_col`` is unique over all owners.
    """
    undone = _undone_moves(ops.select(owner, id_col, op), owner, id_col, op).withColumn("undone", F.lit(1))
    moves = ops.where(F.col(op) == "move").drop(op)
    return moves.join(undone, id_col, "left").withColumn("undone", F.coalesce("undone", F.lit(0)))


def _undone_moves(ops: DataFrame, owner: str, id_col: str, op: str) -> DataFrame:
    """Ids of the moves that an undo cancelled, from the three columns that decide it."""
    steps = ops.where(F.col(op).isin("move", "undo")).select(
        owner, id_col, F.when(F.col(op) == "move", 1).otherwise(-1).alias("__step")
    )
    rows = chunked(steps, [owner], id_chunk(id_col))
    step = F.col("__step")
    base = W.partitionBy(owner, CHUNK).orderBy(id_col)
    rows = rows.withColumn("__sum", F.sum(step).over(base.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("__low", F.min("__sum").over(base.rowsBetween(W.unboundedPreceding, -1)))

    # One summary per chunk: its net change and how far below its start it goes.
    earlier = W.partitionBy(owner).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    chunks = rows.groupBy(owner, CHUNK).agg(F.sum(step).alias("__net"), F.min("__sum").alias("__dip"))
    chunks = chunks.withColumn("__start", F.coalesce(F.sum("__net").over(earlier), F.lit(0)))
    carry = chunks.select(
        owner, CHUNK, "__start", F.min(F.col("__start") + F.col("__dip")).over(earlier).alias("__floor")
    )
    joined = carry_join(rows, carry, [owner])
    floor = F.least(F.lit(0), F.col("__floor"), F.col("__low") + F.col("__start"))
    depth = F.col("__sum") + F.col("__start") - floor

    # An undo that would go below the floor met an empty log.
    is_move = step == 1
    level = F.when(is_move, depth).otherwise(depth + 1)
    effective = joined.where(is_move | (depth >= 0)).select(owner, id_col, "__step", level.alias("__level"))
    effective = materialise(effective, "undo-levels")
    paired = next_value(effective, [owner, "__level"], id_col, id_chunk(id_col), "__step", "__next")
    return paired.where(is_move & (F.col("__next") == -1)).select(id_col)


# --- views ------------------------------------------------------------------------------------------


def live(moves: DataFrame) -> DataFrame:
    return moves.where("undone = 0")


def last_live_move(moves: DataFrame, owner: str = "owner") -> DataFrame:
    """The newest live move of every log."""
    fields = [c for c in moves.columns if c not in (owner, "id")]
    newest = live(moves).groupBy(owner).agg(F.max("id").alias("id"), F.max_by(F.struct(*fields), "id").alias("__move"))
    return newest.select(owner, "id", *[f"__move.{c}" for c in fields])


def recent_moves(moves: DataFrame, limit: int = RECENT_LIMIT) -> DataFrame:
    return moves.orderBy(F.desc("id")).limit(limit)


def recent_moves_flagged(moves: DataFrame, limit: int = RECENT_LIMIT) -> DataFrame:
    """The recent page with ``can_undo`` on its newest live row. The window spans the page only."""
    page = recent_moves(moves, limit)
    newest = F.max(F.when(F.col("undone") == 0, F.col("id"))).over(W.partitionBy())
    return page.withColumn("can_undo", F.coalesce(F.col("id") == newest, F.lit(False)))


def log_view(moves: DataFrame) -> DataFrame:
    """What the log page shows per move."""
    return moves.select(
        "id",
        "ts",
        base_name(F.col("src")).alias("filename"),
        "src",
        "dst",
        percent_text(F.col("confidence")).alias("confidence_text"),
    )


def category_stats(moves: DataFrame) -> DataFrame:
    return live(moves).groupBy("category").agg(F.count("*").alias("count"))


def dashboard_counts(moves: DataFrame) -> DataFrame:
    """Live moves for every category, zeros included, in the fixed order."""
    rows = dimension(
        moves.sparkSession, [(i, c) for i, c in enumerate(CATEGORIES)], "position int, category string"
    )
    return (
        rows.join(category_stats(moves), "category", "left")
        .orderBy("position")
        .select("category", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))
    )


def result_feed(results: DataFrame, order: str, limit: int = FEED_LIMIT) -> DataFrame:
    """Newest results first."""
    return results.orderBy(F.desc(order)).limit(limit)
