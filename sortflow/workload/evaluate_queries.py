"""Evaluation tables over whole tables of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortflow.operators import evaluate as ops
from sortflow.operators.classify import RULE, classify_in_place, with_rule
from sortflow.workload import sqltext as q
from sortflow.workload.registry import query
from sortflow.workload.views import view, with_views

LABELS = ["Docs", "Finance", "Logs", "Study"]


def _report_sql(rows: str, out: str) -> str:
    return f"""{out}_classes as (
        select label,
          case when predicted = 0 then 0 else hits / predicted end as precision,
          case when support = 0 then 0 else hits / support end as recall,
          case when support + predicted = 0 then 0 else 2 * hits / (support + predicted) end as f1_score,
          support, hits
        from (select l.label,
                count(*) filter (r.y_true = l.label and r.y_pred = l.label) as hits,
                count(*) filter (r.y_true = l.label) as support,
                count(*) filter (r.y_pred = l.label) as predicted
              from {rows} r join (select y_true as label from {rows} union select y_pred from {rows}) l
                on r.y_true = l.label or r.y_pred = l.label
              group by l.label)),
      {out} as (
        select label, precision, recall, f1_score, support::double as support from {out}_classes
        union all select 'accuracy', a, a, a, a from (select sum(hits) / sum(support) as a from {out}_classes)
        union all select 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support) from {out}_classes
        union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
          sum(f1_score * support) / sum(support), sum(support) from {out}_classes)"""


def _rounded(report: DataFrame) -> DataFrame:
    return report.select("label", *[F.round(m, 6).alias(m) for m in ops.REPORT_METRICS], "support")


_ROUNDED = "round(precision, 6) as precision, round(recall, 6) as recall, round(f1_score, 6) as f1_score"


@query(
    "eval_summary",
    f"""{with_views('scored')} select count(*) as rows, count(*) filter (y_true <> y_pred) as total_errors,
          round(count(*) filter (y_true = y_pred) / count(*), 6) as accuracy from scored""",
)
def eval_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ops.summary(view(spark, sf, "scored"))


@query(
    "confusion_matrix",
    f"""{with_views('scored')} select l.label as true_label,
          {', '.join(f"count(*) filter (s.y_pred = '{x}') as {x}" for x in LABELS)}
        from (values {', '.join(f"('{x}')" for x in LABELS)}) l(label) left join scored s on s.y_true = l.label
        group by l.label""",
)
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return ops.confusion_matrix(view(spark, sf, "scored"), LABELS)


@query(
    "class_report",
    f"{with_views('scored')}, {_report_sql('scored', 'report')} select label, {_ROUNDED}, support from report_classes",
)
def class_report(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ops.class_report(view(spark, sf, "scored")))


@query(
    "class_report_full",
    f"""{with_views('scored')}, {_report_sql('scored', 'report')}
        select label, {_ROUNDED}, round(support, 6) as support from report""",
)
def class_report_full(spark: SparkSession, sf: str) -> DataFrame:
    report = _rounded(ops.class_report_full(view(spark, sf, "scored")))
    return report.withColumn("support", F.round("support", 6))


@query(
    "top_errors",
    f"""{with_views('scored')} select row_index, filename, y_true as true_label, y_pred as predicted_label,
          round(p_pred, 6) as predicted_confidence, round(p_true, 6) as true_label_probability,
          round(p_pred - p_true, 6) as margin_pred_minus_true,
          replace(substr(content, 1, 220), chr(10), ' ') as content_preview
        from scored where y_true <> y_pred order by predicted_confidence desc, row_index limit 25""",
)
def top_errors(spark: SparkSession, sf: str) -> DataFrame:
    return ops.top_errors(view(spark, sf, "scored"))


@query(
    "mean_loss",
    f"""{with_views('scored')}, placed as (
          select (row_number() over (order by doc_id) - 1) // 16 as batch, -ln(p_true) as loss from scored),
        batches as (select batch, avg(loss) as loss, sum(loss) as total, count(*) as n from placed group by batch)
        select round(avg(loss), 6) as mean_batch_loss, round(sum(total) / sum(n), 6) as mean_row_loss,
          count(*) as batches from batches""",
)
def mean_loss(spark: SparkSession, sf: str) -> DataFrame:
    losses = ops.mean_loss(view(spark, sf, "scored"), "doc_id", 16)
    return losses.select(
        F.round("mean_batch_loss", 6).alias("mean_batch_loss"), F.round("mean_row_loss", 6).alias("mean_row_loss"), "batches"
    )


_FOCUS = ["Docs", "Finance", "Study", "Media"]

_COMPARE_SQL = f"""{_report_sql('scored', 'base')}, {_report_sql('scored_again', 'cand')},
  wanted as (
    select 'accuracy' as label, 'precision' as metric
    union all select label, metric
      from (values ('macro avg'), ('weighted avg'), {', '.join(f"('{x}')" for x in _FOCUS)}) l(label),
           (values ('precision'), ('recall'), ('f1_score')) m(metric)),
  base_long as (unpivot (select label, precision, recall, f1_score from base)
                on precision, recall, f1_score into name metric value baseline),
  cand_long as (unpivot (select label, precision, recall, f1_score from cand)
                on precision, recall, f1_score into name metric value candidate),
  compared as (
    select w.label, case when w.label = 'accuracy' then 'accuracy' else w.metric end as metric, b.baseline,
      c.candidate, c.candidate - b.baseline as delta
    from wanted w left join base_long b on b.label = w.label and b.metric = w.metric
      left join cand_long c on c.label = w.label and c.metric = w.metric)"""


def _comparison(spark: SparkSession, sf: str) -> DataFrame:
    baseline = ops.class_report_full(view(spark, sf, "scored"))
    candidate = ops.class_report_full(view(spark, sf, "scored_again"))
    return ops.compare_runs(baseline, candidate, _FOCUS)


@query(
    "eval_compare",
    f"""{with_views('scored', 'scored_again')}, {_COMPARE_SQL}
        select label, metric, round(baseline, 6) as baseline, round(candidate, 6) as candidate,
          round(delta, 6) as delta, coalesce(format('{{:+.4f}}', delta), 'n/a') as delta_text from compared""",
)
def eval_compare(spark: SparkSession, sf: str) -> DataFrame:
    rounded = [F.round(c, 6).alias(c) for c in ("baseline", "candidate", "delta")]
    return _comparison(spark, sf).select("label", "metric", *rounded, "delta_text")


@query(
    "acceptance_gate",
    f"""{with_views('scored', 'scored_again')}, {_COMPARE_SQL}, flags as (
          select label, coalesce(delta >= -0.005, false) as holds from compared where metric = 'f1_score'),
        gate as (
          select bool_and(holds) filter (label = 'macro avg') as macro_ok,
            bool_and(holds) filter (label = 'weighted avg') as weighted_ok,
            bool_and(holds) filter (label in ('Docs', 'Finance', 'Study')) as focus_ok from flags)
        select *, macro_ok and weighted_ok and focus_ok as accepted from gate""",
)
def acceptance_gate(spark: SparkSession, sf: str) -> DataFrame:
    return ops.acceptance_gate(_comparison(spark, sf))


@query(
    "prediction_checks",
    f"""{with_views('corpus')}, predicted as (
          select doc_id, label as expected, {q.rule('filename')} as ruled, 0.5 + (doc_id * 37 % 499) / 1000 as p,
            label from corpus),
        records as (
          select doc_id, expected, ruled is not null as stable,
            case when ruled is not null then ruled when p < 0.55 then 'Other' else label end as category from predicted)
        select count(*) as files_tested, count(category) as records,
          count(*) filter (category = expected) as matched_expected,
          count(*) filter (category = expected and stable) as stable_matched,
          count(*) filter (category = '') as empty_categories, 0::bigint as bad_confidences,
          array_to_string(list_sort(list(distinct category)), ',') as categories,
          count(*) filter (category = expected) >= 4 and count(*) filter (category = expected and stable) >= 4 as ok
        from records""",
)
def prediction_checks(spark: SparkSession, sf: str) -> DataFrame:
    files = view(spark, sf, "corpus").withColumnRenamed("filename", "filepath")
    score = F.lit(0.5) + ((F.col("doc_id") * 37) % 499) / 1000
    records = classify_in_place(files, F.col("label"), score, keep=("doc_id",))
    expected = with_rule(files.select("doc_id", "filepath", F.col("label").alias("expected"))).select(
        "doc_id", "expected", F.col(RULE).isNotNull().alias("stable")
    )
    return ops.prediction_checks(records, expected, "doc_id", 4, 4)


@query(
    "early_stop",
    f"""{with_views('history')},
        a as (select *, max(val_macro_f1) over (partition by run order by epoch
                rows between unbounded preceding and 1 preceding) as pb from history),
        b as (select *, case when val_macro_f1 > coalesce(pb, -1) then epoch end as imp from a),
        c as (select *, max(imp) over (partition by run order by epoch rows unbounded preceding) as last_imp from b),
        d as (select *, min(case when epoch - last_imp >= 2 then epoch end) over (partition by run) as stop from c)
        select run, max(imp) as best_epoch, max(epoch) as last_epoch, round(max(val_macro_f1), 6) as best_metric,
          bool_or(stop is not null) as stopped_early
        from d where stop is null or epoch <= stop group by run""",
)
def early_stop(spark: SparkSession, sf: str) -> DataFrame:
    stops = ops.early_stop(view(spark, sf, "history"), "run", "epoch", "val_macro_f1", patience=2)
    return stops.withColumn("best_metric", F.round("best_metric", 6))
