"""The move log over a whole event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortflow.operators import movelog as ops
from sortflow.operators.destinations import plan_destinations
from sortflow.plans.workspace import scratch
from sortflow.workload.registry import query, table
from sortflow.workload.views import view, with_views

_REPLAY = """a as (select *, sum(case when op = 'move' then 1 else -1 end)
      over (partition by owner order by id rows unbounded preceding) as s from ops),
  b as (select *, s - least(0, min(s) over (partition by owner order by id rows unbounded preceding)) as depth from a),
  c as (select *, coalesce(lag(depth) over (partition by owner order by id), 0) as prev from b),
  l as (select *, case when op = 'move' then depth else prev end as lvl from c where not (op = 'undo' and prev = 0)),
  n as (select *, lead(op) over (partition by owner, lvl order by id) as next_op from l),
  moves as (select id, owner, category, confidence, src, ts, coalesce(next_op = 'undo', false)::int as undone
            from n where op = 'move')"""

_WITH_MOVES = f"{with_views('ops')}, {_REPLAY}"


def moves(spark: SparkSession, sf: str) -> DataFrame:
    replayed = ops.undo_replay(view(spark, sf, "ops"))
    return replayed.withColumn("dst", F.concat_ws("/", F.lit("/out"), "category", F.substring_index("src", "/", -1)))


@query("undo_replay", f"{_WITH_MOVES} select id, owner, category, undone from moves")
def undo_replay(spark: SparkSession, sf: str) -> DataFrame:
    return ops.undo_replay(view(spark, sf, "ops")).select("id", "owner", "category", "undone")


@query(
    "last_live_move",
    f"{_WITH_MOVES} select owner, id, category, src from moves where undone = 0 "
    "qualify row_number() over (partition by owner order by id desc) = 1",
)
def last_live_move(spark: SparkSession, sf: str) -> DataFrame:
    return ops.last_live_move(moves(spark, sf)).select("owner", "id", "category", "src")


@query(
    "recent_moves",
    f"{_WITH_MOVES} select id, src, category, confidence, undone from moves order by id desc limit 50",
)
def recent_moves(spark: SparkSession, sf: str) -> DataFrame:
    return ops.recent_moves(moves(spark, sf)).select("id", "src", "category", "confidence", "undone")


@query(
    "recent_moves_flag",
    f"""{_WITH_MOVES}, page as (select * from moves order by id desc limit 50)
        select id, undone, id = (select max(id) from page where undone = 0) as can_undo from page""",
)
def recent_moves_flag(spark: SparkSession, sf: str) -> DataFrame:
    return ops.recent_moves_flagged(moves(spark, sf)).select("id", "undone", "can_undo")


@query(
    "movelog_view",
    f"""{_WITH_MOVES} select id, split_part(src, '/', -1) as filename, src,
          '/out/' || category || '/' || split_part(src, '/', -1) as dst,
          round_even(confidence * 100, 0)::bigint || '%' as confidence_text from moves""",
)
def movelog_view(spark: SparkSession, sf: str) -> DataFrame:
    return ops.log_view(moves(spark, sf)).drop("ts")


@query("category_stats", f"{_WITH_MOVES} select category, count(*) as count from moves where undone = 0 group by category")
def category_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ops.category_stats(moves(spark, sf))


@query(
    "dashboard_counts",
    f"""{_WITH_MOVES} select c.category, count(m.id) as count
        from (values ('Code'), ('Docs'), ('Finance'), ('Study'), ('Media'), ('Archives'), ('Logs'), ('Other')) c(category)
        left join moves m on m.category = c.category and m.undone = 0 group by c.category""",
)
def dashboard_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ops.dashboard_counts(moves(spark, sf))


_ROUTED = """routed as (
  select event_id, round(value / 100, 3) as confidence, user_id % 2 = 0 as auto_move, event_type = 'error' as failed
  from events),
  statuses as (select event_id, confidence,
    case when not auto_move then 'Pending' when confidence < 0.55 then 'Skipped (< 0.55)' when failed then 'Error'
      else 'Moved' end as status from routed)"""


def _routed(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("confidence", F.round(F.col("value") / 100, 3))
    status = ops.route_status(
        F.col("confidence"), F.col("user_id") % 2 == 0, F.col("event_type") == "error"
    )
    return rows.select("event_id", "confidence", status.alias("status"))


@query(
    "route_status",
    f"""with {_ROUTED} select event_id, status,
          case when status <> 'Pending' then status when confidence < 0.55 then 'Skipped (< 0.55)' else 'Moved' end
            as applied from statuses""",
)
def route_status(spark: SparkSession, sf: str) -> DataFrame:
    """Status on arrival, and after all pending rows are applied."""
    routed = _routed(spark, sf).withColumn("arrived", F.col("status"))
    return ops.apply_all_pending(routed).select(
        "event_id", F.col("arrived").alias("status"), F.col("status").alias("applied")
    )


@query("result_feed", f"with {_ROUTED} select event_id, confidence, status from statuses order by event_id desc limit 100")
def result_feed(spark: SparkSession, sf: str) -> DataFrame:
    return ops.result_feed(_routed(spark, sf), "event_id")


_FILES = """files as (
  select event_id as seq, event_type as category, 'f' || (event_id % 40) || '.txt' as name from events)"""


@query(
    "plan_destinations",
    f"""with {_FILES} select seq, category, name, '/out/' || category || '/' ||
          case when place = 0 then name else replace(name, '.txt', '_' || place || '.txt') end as destination
        from (select *, row_number() over (partition by category, name order by seq) - 1 as place from files)""",
)
def plan_destinations_query(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("category"),
        F.concat(F.lit("f"), (F.col("event_id") % 40).cast("string"), F.lit(".txt")).alias("name"),
    )
    return plan_destinations(files, "/out")


_CONTENDED = """files as (select event_id as seq, event_type as category,
    case when event_id % 3 = 0 then 'f.txt' else 'f_' || (event_id * 7 % 5) || '.txt' end as name from events),
  disk as (select distinct event_type as category, user_id as k, 'f_' || user_id || '.txt' as name from events),
  placed as (select *, row_number() over (partition by category, name order by seq) - 1 as p from files),
  slots as (select c.category, k, any_value(d.name) is not null as on_disk, min(f.seq) as first
    from (select distinct category from files) c cross join range(1, 5) t(k)
    left join disk d using (category, k) left join files f on f.category = c.category and f.name = 'f_' || k || '.txt' group by all),
  claims as (select s.category, s.k, any_value(on_disk) as on_disk, any_value(first) as first, count(r.seq) as before
    from slots s left join files r on r.category = s.category and r.name = 'f.txt' and r.seq < s.first group by all),
  walk(category, k, skipped, skips) as (select distinct category, 0::bigint, 0::bigint, false from files
    union all select w.category, c.k, skipped + (on_disk or (first is not null and c.k - skipped >= before))::bigint,
      on_disk or (first is not null and c.k - skipped >= before)
      from walk w join claims c on c.category = w.category and c.k = w.k + 1),
  closed as (select category, k from walk where skips union select category, k from disk where k > 0),
  room as (select category, count(*) + (select count(*) from closed x where x.category = f.category) as n
    from files f where name = 'f.txt' group by category),
  free as (select category, slot, row_number() over (partition by category order by slot) - 1 as p
    from (select category, unnest(range(0, n + 1)) as slot from room) r
    where not exists (select 1 from closed x where x.category = r.category and x.k = r.slot)),
  gone as (select category, name from disk union
    select c.category, 'f_' || c.k || '.txt' from claims c join walk w using (category, k) where first is not null and not skips),
  slotted as (select seq, category, name, p + (g.name is not null)::bigint as slot
    from placed left join gone g using (category, name) where placed.name <> 'f.txt'
    union all select seq, category, name, slot from placed join free using (category, p) where name = 'f.txt')"""


@query(
    "plan_destinations_contended",
    f"""with recursive {_CONTENDED} select seq, category, name, '/out/' || category || '/' ||
          case when slot = 0 then name else replace(name, '.txt', '_' || slot || '.txt') end as destination from slotted""",
)
def plan_destinations_contended(spark: SparkSession, sf: str) -> DataFrame:
    """Names that are numbered forms of one another, and folders that already hold files."""
    events = table(spark, sf, "events")
    number = (F.col("event_id") * 7 % 5).cast("string")
    name = F.when(F.col("event_id") % 3 == 0, F.lit("f.txt")).otherwise(F.concat(F.lit("f_"), number, F.lit(".txt")))
    files = events.select(F.col("event_id").alias("seq"), F.col("event_type").alias("category"), name.alias("name"))
    existing = events.select(
        F.col("event_type").alias("category"), F.concat(F.lit("f_"), F.col("user_id").cast("string"), F.lit(".txt")).alias("name")
    ).distinct()
    return plan_destinations(files, "/out", existing)


_NUMBERED = """files as (select event_id as seq, event_id % 2 = 0 as plain, case when event_id % 2 = 0 then 0 else event_id * 7919 % 4999 + 1 end as k,
    sum((event_id % 2 = 0)::bigint) over (order by event_id rows unbounded preceding) as before from events),
  placed as (select *, row_number() over (partition by k order by seq) - 1 as p from files),
  claims as materialized (select *, row_number() over (order by k) as i from (select k, min(before) as before from files where not plain group by k)),
  walk(i, k, skipped, skips) as (select 0::bigint, 0::bigint, 0::bigint, false
    union all select c.i, c.k, skipped + (c.k - skipped >= before)::bigint, c.k - skipped >= before from walk w join claims c on c.i = w.i + 1),
  closed as (select k from walk where skips),
  free as (select slot, row_number() over (order by slot) - 1 as p
    from (select unnest(range(0, (select count(*) from files where plain) + (select count(*) from closed) + 1)) as slot)
    where slot not in (select k from closed)),
  slotted as (select seq, 'n.txt' as name, slot from placed join free using (p) where plain
    union all select seq, 'n_' || x.k || '.txt', p + (w.i is not null)::bigint
      from placed x left join walk w on w.k = x.k and not skips and w.i > 0 where not plain)"""


@query(
    "plan_destinations_numbered",
    f"""with recursive {_NUMBERED} select seq, 'Docs' as category, name, '/out/Docs/' ||
          case when slot = 0 then name else replace(name, '.txt', '_' || slot || '.txt') end as destination from slotted""",
)
def plan_destinations_numbered(spark: SparkSession, sf: str) -> DataFrame:
    """One family of very many numbered names: every other file is ``n.txt``, the others ``n_1.txt``, ``n_2.txt``, ... in mixed order."""
    events = table(spark, sf, "events").select(F.col("event_id").alias("seq"))
    number = (F.col("seq") * 7919 % 4999 + 1).cast("string")
    name = F.when(F.col("seq") % 2 == 0, F.lit("n.txt")).otherwise(F.concat(F.lit("n_"), number, F.lit(".txt")))
    return plan_destinations(events.select("seq", F.lit("Docs").alias("category"), name.alias("name")), "/out")


@query(
    "movelog_append",
    f"""{with_views('ops')} select row_number() over (order by late, id) as id, src, '/out/' || category as dst, category,
          confidence, undone from (select *, op <> 'move' as skipped, month(ts) <> 1 or day(ts) > 15 as late, 0 as undone
          from ops) where not skipped""",
)
def movelog_append(spark: SparkSession, sf: str) -> DataFrame:
    """All moves appended in two batches, the second one twice as after a restart."""
    rows = view(spark, sf, "ops").where("op = 'move'").withColumn("dst", F.concat(F.lit("/out/"), "category"))
    late = (F.month("ts") != 1) | (F.dayofmonth("ts") > 15)
    path = scratch(spark, "movelog")
    ops.append_moves(path, rows.where(~late), "id", "first")
    for _ in range(2):
        ops.append_moves(path, rows.where(late), "id", "second")
    return ops.read_moves(spark, path).drop("ts")


@query(
    "movelog_snapshot",
    f"""{_WITH_MOVES}, numbered as (select id, row_number() over (order by id) as n from ops)
        select n as id, cast(owner as varchar) as owner, src, category, confidence from moves join numbered using (id) where undone = 0""",
)
def movelog_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """All operations appended in four batches and folded in between; a folded batch is appended again, as after a restart."""
    rows = view(spark, sf, "ops").withColumn("dst", F.concat(F.lit("/out/"), "category"))
    last = rows.agg(F.max("id")).first()[0] or 0
    path = scratch(spark, "movelog")
    for k in range(4):
        batch = rows.where(F.col("id").between(last * k // 4 + (k > 0), last * (k + 1) // 4))
        ops.append_operations(path, batch, "id", str(k))
        if k == 1:
            ops.fold_log(spark, path)
            ops.append_operations(path, batch, "id", str(k))
    return ops.live_moves(spark, path).select("id", "owner", "src", "category", "confidence")
