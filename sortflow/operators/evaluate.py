"""Evaluation tables over (row id, y_true, y_pred, p_pred, p_true), run comparison, history scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortflow.functions.text import error_preview, signed_delta
from sortflow.functions.vocabulary import FOCUS_LABELS
from sortflow.plans.broadcasting import dimension
from sortflow.plans.scan import Running, dense_index, id_chunk, running

REPORT_METRICS = ["precision", "recall", "f1_score"]
AVERAGE_ROWS = ["macro avg", "weighted avg"]
DEFAULT_TOLERANCE = 0.005


def evaluation_rows(scored: DataFrame, labels: Sequence[str], order: str, truth: str = "label") -> DataFrame:
    """Rows of a scored table as the tables here take them: truth, prediction and their probabilities.

    ``probabilities`` is an array in the order of ``labels``; a truth the model does not know has probability 0.
    """
    names = F.array(*[F.lit(x) for x in labels])
    own = F.get("probabilities", (F.array_position(names, F.col(truth)) - 1).cast("int"))
    return scored.select(
        F.col(order).alias("row_index"),
        *[c for c in ("filename", "filepath", "content") if c in scored.columns],
        F.col(truth).alias("y_true"),
        F.col("category").alias("y_pred"),
        F.col("confidence").alias("p_pred"),
        F.coalesce(own, F.lit(0.0)).alias("p_true"),
    )


def full_summary(df: DataFrame, train_rows: int, labels: Sequence[str]) -> DataFrame:
    """One row: the summary of held-out rows, the rows trained on, and the labels."""
    return summary(df).withColumnRenamed("rows", "validation_rows").select(
        F.lit(train_rows).cast("bigint").alias("train_rows"), "*", F.array(*[F.lit(x) for x in labels]).alias("labels")
    )


def summary(df: DataFrame) -> DataFrame:
    """One row: rows, errors, accuracy."""
    errors = F.count_if(F.col("y_true") != F.col("y_pred"))
    return df.agg(
        F.count("*").alias("rows"),
        errors.alias("total_errors"),
        F.round(F.count_if(F.col("y_true") == F.col("y_pred")) / F.count("*"), 6).alias("accuracy"),
    )


def pair_counts(df: DataFrame) -> DataFrame:
    """(y_true, y_pred, n): all later tables are computed from these few rows."""
    return df.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """One row per label and one count column per label, in the order given, zeros included.

    Without ``labels``, those found as truth or prediction, sorted. A list that lacks a label found is an error.
    """
    side = F.explode(F.array("y_true", "y_pred")).alias("label")
    found = [r.label for r in pair_counts(df).select(side).where("label is not null").distinct().orderBy("label").collect()]
    labels = found if labels is None else list(labels)
    if absent := sorted(set(found) - set(labels)):
        raise ValueError(f"Labels found in the data are not in the list: {absent}")
    rows = dimension(df.sparkSession, [(i, x) for i, x in enumerate(labels)], "position int, true_label string")
    cells = pair_counts(df).groupBy("y_true").agg(
        *[F.sum(F.when(F.col("y_pred") == x, F.col("n")).otherwise(0)).alias(x) for x in labels]
    )
    joined = rows.join(cells, F.col("true_label") == F.col("y_true"), "left")
    return joined.orderBy("position").select(
        "true_label", *[F.coalesce(F.col(f"`{x}`"), F.lit(0)).cast("bigint").alias(x) for x in labels]
    )


def class_report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label seen as truth or prediction; 0 where undefined."""
    hits = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("bigint")

    def side(label: str, hits: Column, support: Column, predicted: Column) -> Column:
        return F.struct(
            F.col(label).alias("label"), hits.alias("hits"), support.alias("support"), predicted.alias("predicted")
        )

    # Each pair counts once for its truth and once for its prediction.
    sides = pair_counts(df).select(
        F.inline(F.array(side("y_true", hits, F.col("n"), none), side("y_pred", none, none, F.col("n"))))
    )
    sums = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("hits", "support", "predicted")])

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    return sums.select(
        "label",
        ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1_score"),
        F.col("support").cast("bigint").alias("support"),
        F.col("hits").cast("bigint").alias("hits"),
    )


def class_report_full(df: DataFrame) -> DataFrame:
    """The class report plus the accuracy, macro and weighted rows; the accuracy row repeats one value.

    Every class row also feeds the three summary lines, so the input is read once.
    """
    lines = F.array(
        F.struct(F.lit("class").alias("kind"), F.col("label").alias("line")),
        *[F.struct(F.lit(name).alias("kind"), F.lit(name).alias("line")) for name in ("accuracy", *AVERAGE_ROWS)],
    )
    fed = class_report(df).select("*", F.inline(lines))
    support = F.sum("support").cast("double")

    def value(metric: str) -> Column:
        return (
            F.when(F.col("kind") == "accuracy", F.sum("hits") / F.sum("support"))
            .when(F.col("kind") == "weighted avg", F.sum(F.col(metric) * F.col("support")) / support)
            .otherwise(F.avg(metric))
        )

    shown_support = F.when(F.col("kind") == "accuracy", F.sum("hits") / F.sum("support")).otherwise(support)
    return (
        fed.groupBy("kind", "line")
        .agg(*[value(m).alias(m) for m in REPORT_METRICS], shown_support.alias("support"))
        .select(F.col("line").alias("label"), *REPORT_METRICS, "support")
    )


def top_errors(df: DataFrame, limit: int = 25, order: str = "row_index") -> DataFrame:
    """The most confident wrong rows; equal rounded confidences stay in row order."""
    wrong = df.where(F.col("y_true") != F.col("y_pred"))
    return (
        wrong.select(
            F.col(order).alias("row_index"),
            "filename",
            F.col("y_true").alias("true_label"),
            F.col("y_pred").alias("predicted_label"),
            F.round("p_pred", 6).alias("predicted_confidence"),
            F.round("p_true", 6).alias("true_label_probability"),
            F.round(F.col("p_pred") - F.col("p_true"), 6).alias("margin_pred_minus_true"),
            error_preview(F.col("content")).alias("content_preview"),
        )
        .orderBy(F.desc("predicted_confidence"), "row_index")
        .limit(max(0, limit))
    )


def mean_loss(df: DataFrame, id_col: str, batch_size: int) -> DataFrame:
    """Mean of batch means of -ln(p_true), batches of consecutive rows; and the plain row mean.

    A probability of 0 is an infinite loss; a missing one is no loss at all and makes the means missing.
    """
    loss = F.when(F.col("p_true") <= 0, float("inf")).when(F.col("p_true").isNull(), float("nan")).otherwise(-F.log("p_true"))
    placed = dense_index(df.select(id_col, "p_true"), [], [id_col], id_chunk(id_col), "__row")
    batches = placed.groupBy(F.floor(F.col("__row") / batch_size).alias("batch")).agg(
        F.avg(loss).alias("loss"), F.sum(loss).alias("total"), F.count("*").alias("n")
    )
    return batches.agg(
        F.avg("loss").alias("mean_batch_loss"),
        (F.sum("total") / F.sum("n")).alias("mean_row_loss"),
        F.count("*").alias("batches"),
    )


def compare_runs(
    baseline: DataFrame, candidate: DataFrame, focus: Sequence[str] = tuple(FOCUS_LABELS)
) -> DataFrame:
    """Baseline, candidate and delta per (label, metric) of two full reports; a missing side gives n/a."""
    spark = baseline.sparkSession
    wanted = [("accuracy", "precision")] + [(x, m) for x in [*AVERAGE_ROWS, *focus] for m in REPORT_METRICS]
    lines = dimension(spark, [(i, *row) for i, row in enumerate(wanted)], "position int, label string, metric string")

    def long(report: DataFrame, name: str) -> DataFrame:
        return report.unpivot("label", REPORT_METRICS, "metric", name)

    both = long(baseline, "baseline").join(long(candidate, "candidate"), ["label", "metric"], "full")
    delta = F.col("candidate") - F.col("baseline")
    metric = F.when(F.col("label") == "accuracy", "accuracy").otherwise(F.col("metric"))
    return (
        lines.join(both, ["label", "metric"], "left")
        .orderBy("position")
        .select(
            "label",
            metric.alias("metric"),
            "baseline",
            "candidate",
            delta.alias("delta"),
            signed_delta(delta).alias("delta_text"),
        )
    )


def acceptance_gate(
    comparison: DataFrame, focus: Sequence[str] = tuple(FOCUS_LABELS), tolerance: float = DEFAULT_TOLERANCE
) -> DataFrame:
    """One row: averages and focus labels keep their F1 within ``tolerance``; a missing value fails."""
    holds = F.coalesce(F.col("delta") >= -tolerance, F.lit(False))
    is_f1 = F.col("metric") == "f1_score"

    def all_of(labels: Sequence[str]):
        return F.coalesce(F.bool_and(F.when(is_f1 & F.col("label").isin(list(labels)), holds)), F.lit(False))

    gate = comparison.agg(
        all_of(["macro avg"]).alias("macro_ok"),
        all_of(["weighted avg"]).alias("weighted_ok"),
        all_of(focus).alias("focus_ok"),
    )
    return gate.withColumn("accepted", F.expr("macro_ok and weighted_ok and focus_ok"))


def prediction_checks(
    predictions: DataFrame, expected: DataFrame, key: str, min_matches: int, min_stable: int
) -> DataFrame:
    """One row of checks. ``expected`` has (key, expected, stable); stable rows are those a rule decides.

    Files and records are counted apart: every file needs exactly one record. A file predicted more than once
    counts once, with its first category by name.
    """
    made = predictions.groupBy(key).agg(
        F.count("*").alias("made"), F.min(F.struct("category", "confidence")).alias("first")
    )
    joined = expected.join(made, key, "full").select(
        "*", F.col("first.category").alias("category"), F.col("first.confidence").alias("confidence")
    )
    tested = F.col("expected").isNotNull()
    match = F.coalesce(F.col("category") == F.col("expected"), F.lit(False))
    checks = joined.agg(
        F.count_if(tested).alias("files_tested"),
        F.coalesce(F.sum("made"), F.lit(0)).alias("records"),
        F.count_if(match).alias("matched_expected"),
        F.count_if(match & F.col("stable")).alias("stable_matched"),
        F.count_if(F.coalesce(F.col("category"), F.lit("")) == "").alias("empty_categories"),
        F.count_if(tested & (F.coalesce("made", F.lit(0)) != 1)).alias("not_single"),
        F.count_if(~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False))).alias("bad_confidences"),
        F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"),
    )
    ok = (
        (F.col("records") == F.col("files_tested"))
        & (F.col("not_single") == 0)
        & (F.col("empty_categories") == 0)
        & (F.col("bad_confidences") == 0)
        & (F.col("matched_expected") >= min_matches)
        & (F.col("stable_matched") >= min_stable)
    )
    return checks.withColumn("ok", ok).drop("not_single")


def early_stop(
    history: DataFrame,
    run: str,
    epoch: str,
    metric: str,
    patience: int,
    start: float = -1.0,
) -> DataFrame:
    """Best and last epoch per run: strictly better counts, and ``patience`` epochs without end the run.

    Runs may have any number of epochs: all scans are chunked by epoch. A metric that is no number never improves.
    """
    chunk = id_chunk(epoch)
    history = history.withColumn(metric, F.nanvl(F.col(metric), F.lit(None).cast("double")))
    scanned = running(
        history, [run], [epoch], chunk, Running("__best_before", "max", F.col(metric), inclusive=False)
    )
    better = F.col(metric) > F.greatest("__best_before", F.lit(start))
    scanned = scanned.withColumn("__improved", F.when(better, F.col(epoch)))
    scanned = running(scanned, [run], [epoch], chunk, Running("__last", "max", F.col("__improved")))
    waited = F.col(epoch) - F.coalesce("__last", F.lit(0))
    scanned = scanned.withColumn("__stop", F.when(waited >= patience, F.col(epoch)))
    # The first stopping row knows the last improvement and the best value before it.
    runs = scanned.groupBy(run).agg(
        F.min("__stop").alias("__stop"),
        F.min_by("__last", "__stop").alias("__stop_best"),
        F.min_by("__best_before", "__stop").alias("__stop_metric"),
        F.max("__improved").alias("__best"),
        F.max(F.when(F.col("__improved").isNotNull(), F.col(metric))).alias("__metric"),
        F.max(epoch).alias("__end"),
    )
    stopped = F.col("__stop").isNotNull()
    return runs.select(
        run,
        F.when(stopped, F.col("__stop_best")).otherwise(F.col("__best")).alias("best_epoch"),
        F.coalesce("__stop", "__end").alias("last_epoch"),
        F.when(stopped, F.col("__stop_metric")).otherwise(F.col("__metric")).alias("best_metric"),
        stopped.alias("stopped_early"),
    )


def saved_history(history: DataFrame, stops: DataFrame, run: str, epoch: str) -> DataFrame:
    """The epochs a run leaves on record: up to its best one."""
    return history.join(stops.select(run, "best_epoch"), run).where(F.col(epoch) <= F.col("best_epoch")).drop("best_epoch")


def save_artifacts(df: DataFrame, labels: Sequence[str], path: str, content: DataFrame | None = None) -> None:
    """Report, matrix, errors and summary below ``path``, as csv and json."""
    tables = {
        "classification_report": class_report_full(df).orderBy("label"),
        "confusion_matrix": confusion_matrix(df, labels),
        "summary": summary(df),
    }
    if content is not None:
        tables["top_errors"] = top_errors(content)
    for name, table in tables.items():
        table.write.mode("overwrite").csv(f"{path}/{name}.csv", header=True)
        table.write.mode("overwrite").json(f"{path}/{name}.json")
