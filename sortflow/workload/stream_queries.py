"""Streams over the driver's tables, run until all input is read; each result is read back from its sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortflow.functions.paths import visible_name
from sortflow.operators.movelog import read_moves
from sortflow.plans.workspace import scratch
from sortflow.streaming import flows as streams
from sortflow.workload import sqltext as q
from sortflow.workload.classify_queries import _FALLBACK_SQL, _RULED, stand_in_score
from sortflow.workload.move_queries import _WITH_MOVES
from sortflow.workload.registry import query, table
from sortflow.workload.views import VIEWS, with_views


def stream_view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    source, text = VIEWS[name]
    schema = table(spark, sf, source).schema
    return spark.sql(text, **{source: streams.watch_table(spark, sf, schema, f"{source}.parquet")})


def _arrivals(spark: SparkSession, sf: str) -> DataFrame:
    return stream_view(spark, sf, "corpus").withColumnRenamed("filename", "filepath")


def _landed(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    folder = scratch(spark, name)
    streams.append_sink(stream, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@query(
    "stream_files",
    f"{with_views('corpus')} select doc_id, filename as filepath, length(content) as n_chars from corpus where filename <> ''",
)
def stream_files(spark: SparkSession, sf: str) -> DataFrame:
    arrivals = _arrivals(spark, sf).where(visible_name(F.col("filepath")))
    return _landed(
        spark,
        arrivals.select("doc_id", "filepath", F.char_length("content").cast("bigint").alias("n_chars")),
        "stream-files",
    )


@query(
    "stream_classify",
    f"""{with_views('corpus')}, {_RULED}, {_FALLBACK_SQL} select *, {q.icon('category')} as icon from records
        where filename <> ''""",
)
def stream_classify(spark: SparkSession, sf: str) -> DataFrame:
    records = streams.classify_stream(_arrivals(spark, sf), F.col("label"), stand_in_score(), keep=("doc_id",))
    return _landed(spark, records, "stream-classify")


@query(
    "stream_route",
    f"""{with_views('corpus')}, {_RULED}, {_FALLBACK_SQL}
        select row_number() over (order by doc_id) as id, filepath as src, '/out/' || category || '/' || filename as dst,
          category, confidence, 0 as undone from records where filename <> '' and confidence >= 0.55""",
)
def stream_route(spark: SparkSession, sf: str) -> DataFrame:
    records = streams.classify_stream(_arrivals(spark, sf), F.col("label"), stand_in_score(), keep=("doc_id",))
    folder = scratch(spark, "stream-route")
    log = f"{folder}/log"
    streams.auto_move(records.withColumnRenamed("doc_id", "seq"), log, "/out", f"{folder}/checkpoint").awaitTermination()
    return read_moves(spark, log).drop("ts")


@query("stream_counts", f"{_WITH_MOVES} select category, count(*) as count from moves where undone = 0 group by category")
def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Moves and undos as a stream; the counts left are those of the live moves."""
    ops = stream_view(spark, sf, "ops")
    folder = scratch(spark, "stream-counts")
    streams.live_counts(ops, f"{folder}/counts", f"{folder}/checkpoint").awaitTermination()
    return streams.latest_counts(spark, f"{folder}/counts")


@query(
    "stream_announcements",
    f"""{with_views('ops')} select distinct src as filepath, split_part(src, '/', -1) as filename, 'Docs' as category,
          0.9::double as confidence from ops""",
)
def stream_announcements(spark: SparkSession, sf: str) -> DataFrame:
    """Files that are announced many times, each classified once."""
    seen = stream_view(spark, sf, "ops").select(F.col("src").alias("filepath"), F.lit("").alias("content"), F.col("ts").alias("modified"))
    records = streams.classify_stream(streams.once_per_file(seen), F.lit("Docs"), F.lit(0.9))
    return _landed(spark, records.select("filepath", "filename", "category", "confidence"), "stream-announcements")


@query(
    "stream_daily_counts",
    f"""{with_views('ops')}, moved as (select category, ts, date_trunc('day', ts) as day from ops where op = 'move')
        select cast(day as date) as day, category, count(*) as count from moved group by all
        having day + interval 1 day <= (select max(ts) - interval 1 hour from moved)""",
)
def stream_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Moves per day and category, of the days that the watermark has closed."""
    counts = streams.daily_counts(stream_view(spark, sf, "ops").where("op = 'move'"))
    return _landed(spark, counts.withColumn("day", F.to_date("day")), "stream-daily")
