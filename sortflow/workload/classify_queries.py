"""Rules, scores, training and scoring over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortflow.functions.labels import reject_low
from sortflow.functions.text import result_preview
from sortflow.functions.vocabulary import DEFAULT_CATEGORY
from sortflow.operators import classify as ops
from sortflow.operators import perceptron
from sortflow.operators import evaluate as ev
from sortflow.operators.corpus import stratified_cap, stratified_split
from sortflow.operators.evaluate import REPORT_METRICS, class_report_full
from sortflow.plans.workspace import materialise
from sortflow.workload import sqltext as q
from sortflow.workload.registry import query, table
from sortflow.workload.views import view, with_views

WIDTH = 64
LOGIT_LABELS = [f"class_{i:02d}" for i in range(WIDTH)]


@query(
    "softmax_argmax",
    """with shifted as (
         select vec_id, embedding,
           list_transform(embedding, lambda x: exp(x::double - list_max(embedding)::double)) as e from embeddings),
       p as (select vec_id, embedding, list_transform(e, lambda x: x / list_sum(e)) as p from shifted)
       select vec_id, 'class_' || lpad((list_position(p, list_max(p)) - 1)::varchar, 2, '0') as category,
         round(list_max(p), 6) as confidence, round(p[8], 6) as p_class_07, round(list_sum(p), 6) as total from p""",
)
def softmax_argmax(spark: SparkSession, sf: str) -> DataFrame:
    logits = table(spark, sf, "embeddings").select("vec_id", "embedding")
    scored = ops.softmax_prediction(logits, "embedding", LOGIT_LABELS)
    total = F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda acc, x: acc + x)
    return scored.select(
        "vec_id",
        "category",
        F.round("confidence", 6).alias("confidence"),
        F.round(F.try_element_at("probabilities", F.lit("class_07")), 6).alias("p_class_07"),
        F.round(total, 6).alias("total"),
    )


_RULED = f"""ruled as (
  select *, {q.rule('filename')} as ruled, {q.base_name('filename')} as base,
    case {q.rule('filename')} when 'Media' then 0.99 when 'Archives' then 0.99 when 'Code' then 0.98 when 'Logs' then 0.98
      end as rule_confidence,
    0.5e0 + cast((doc_id * 37) % 499 as double) / 1000 as p from corpus)"""

_STAND_IN = 0.5


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "corpus").withColumnRenamed("filename", "filepath")


def stand_in_score():
    """A score that SQL can state, in place of a model's."""
    return F.lit(_STAND_IN) + ((F.col("doc_id") * 37) % 499).cast("double") / 1000


@query(
    "rule_classify",
    f"""{with_views('corpus')}, {_RULED}
        select doc_id, filename as filepath, base as filename, ruled as category, {q.icon('ruled')} as icon,
          rule_confidence::double as confidence, '' as content_preview from ruled where ruled is not null""",
)
def rule_classify(spark: SparkSession, sf: str) -> DataFrame:
    return ops.classify_by_rule(_files(spark, sf), "doc_id")


_FALLBACK_SQL = f"""records as (
  select doc_id, filename as filepath, base as filename,
    coalesce(ruled, case when p < 0.55 then 'Other' else label end) as category,
    coalesce(rule_confidence::double, round(p, 3)) as confidence,
    case when ruled is null then {q.strip('substr(content, 1, 120)')} else '' end as content_preview from ruled)"""


@query(
    "rule_or_fallback",
    f"{with_views('corpus')}, {_RULED}, {_FALLBACK_SQL} select *, {q.icon('category')} as icon from records",
)
def rule_or_fallback(spark: SparkSession, sf: str) -> DataFrame:
    def score(df: DataFrame) -> DataFrame:
        return df.withColumn("category", F.col("label")).withColumn("confidence", stand_in_score())

    return ops.classify(_files(spark, sf), score, keep=["doc_id"])


@query(
    "reject_other",
    f"""{with_views('scored')} select doc_id, case when p_pred < 0.55 then 'Other' else y_pred end as category,
          round(p_pred, 3) as confidence from scored""",
)
def reject_other(spark: SparkSession, sf: str) -> DataFrame:
    scored = view(spark, sf, "scored")
    return scored.select(
        "doc_id", reject_low(F.col("y_pred"), F.col("p_pred")).alias("category"), F.round("p_pred", 3).alias("confidence")
    )


@query(
    "fail_soft",
    f"""{with_views('scored')}, joined as (
          select s.doc_id, s.filename, s.content, s.y_pred, case when l.doc_id is not null then s.p_pred end as p
          from scored s left join labels l on s.doc_id = l.doc_id),
        records as (
          select doc_id, filename as filepath, filename,
            case when p is null or p < 0.55 then 'Other' else y_pred end as category,
            case when p is null then 0.0 else round(p, 3) end::double as confidence,
            case when p is null then '' else {q.strip('substr(content, 1, 120)')} end as content_preview from joined)
        select *, {q.icon('category')} as icon from records""",
)
def fail_soft(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a label stand for rows whose scoring failed."""
    labelled = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("ok"))
    joined = view(spark, sf, "scored").join(labelled, "doc_id", "left").select(
        "doc_id",
        F.col("filename").alias("filepath"),
        "content",
        F.col("y_pred").alias("category"),
        F.when(F.col("ok"), F.col("p_pred")).alias("confidence"),
    )
    return ops.prediction_record(
        joined.withColumn("content_preview", result_preview(F.col("content"))), 0.55, "doc_id"
    )


# --- a model over the vectors, scored in batches ----------------------------------------------------


def centroid_model(centroids: np.ndarray) -> Callable:
    """Maker of a predict function: class probabilities from dot products with class means."""

    def make_predict_fn() -> Callable:
        weights = centroids.T

        def predict(inputs: np.ndarray) -> np.ndarray:
            logits = inputs.astype(np.float64) @ weights
            logits -= logits.max(axis=1, keepdims=True)
            e = np.exp(logits)
            return (e / e.sum(axis=1, keepdims=True)).astype(np.float32)

        return predict

    return make_predict_fn


@query(
    "external_score",
    """with cells as (select label, unnest(embedding)::double as x, unnest(range(0, 64)) as i from embeddings),
       means as (select label, i, avg(x) as m from cells group by label, i),
       centroids as (select label, list(m order by i) as c from means group by label),
       logits as (
         select e.vec_id, c.label,
           list_sum(list_transform(range(1, 65), lambda i: e.embedding[i]::double * c.c[i])) as z
         from embeddings e, centroids c),
       p as (select vec_id, label, exp(z - max(z) over w) / sum(exp(z)) over w * exp(max(z) over w) as p from logits
             window w as (partition by vec_id))
       select vec_id, arg_max(label, p)::varchar as category, round(max(p), 4) as confidence from p group by vec_id""",
)
def external_score(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    means = (
        vectors.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
        .groupBy("label")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))
        .orderBy("label")
        .collect()
    )
    make = centroid_model(np.array([r.centroid for r in means]))
    score = ops.external_scorer(make, "embedding", WIDTH, [str(r.label) for r in means])
    scored = score(vectors.select("vec_id", "embedding"))
    return scored.select("vec_id", "category", F.round("confidence", 4).alias("confidence"))


# --- the trained classifier -------------------------------------------------------------------------

_models: dict[tuple[str, str], PipelineModel] = {}

#: Labelled rows the classifier learns from at most, in label proportion; features and iterations are not cut.
MAX_LABELLED_ROWS = 20_000
#: Least accuracy on held-out rows: the labels follow from the language of the text.
ACCURACY_FLOOR = 0.9
PERCEPTRON_FLOOR = 0.95

_SPLIT_SQL = f"""{with_views('corpus')}, counts as (select label, count(*) as n from corpus group by label),
  whole as (select sum(n)::bigint as n, sum(n)::bigint - ceil(0.2 * sum(n))::bigint as draws from counts),
  shares as (select label, counts.n, draws, counts.n * draws // whole.n as base, counts.n * draws % whole.n as rest from counts, whole),
  placed as (select *, draws - sum(base) over () as missing, row_number() over (order by rest desc, label) as place from shares),
  held_out as (select label, n - base - case when place <= missing and rest > 0 then 1 else 0 end as support from placed)"""


def split_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return stratified_split(view(spark, sf, "corpus"), "label", "doc_id")


def trained_model(spark: SparkSession, sf: str) -> PipelineModel:
    """The classifier of the training rows, fitted once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _models:
        train = split_corpus(spark, sf).where("split = 'train'")
        train = stratified_cap(train, "label", "doc_id", MAX_LABELLED_ROWS)
        _models[key] = ops.train_classifier(train, "doc_id", algorithm="logistic")
    return _models[key]


def held_out_report(spark: SparkSession, sf: str) -> DataFrame:
    """Class report of the trained classifier on the held-out rows."""
    held_out = split_corpus(spark, sf).where("split = 'validation'").withColumnRenamed("filename", "filepath")
    scored = ops.model_scorer(trained_model(spark, sf))(held_out)
    return class_report_full(scored.select(F.col("label").alias("y_true"), F.col("category").alias("y_pred")))


@query(
    "train_classifier",
    f"""{_SPLIT_SQL} select label, cast(support as double) as support, true as ok from held_out
        union all select 'accuracy', null, true
        union all select name, (select cast(sum(support) as double) from held_out), true
          from (values ('macro avg'), ('weighted avg')) v(name)""",
)
def train_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """The report in terms that SQL can state: supports, and whether metrics and accuracy are where they have to be."""
    metrics = [F.col(m) for m in REPORT_METRICS]
    inside = reduce(lambda a, b: a & b, [m.between(0, 1) for m in metrics])
    is_accuracy = F.col("label") == "accuracy"
    return held_out_report(spark, sf).select(
        "label",
        F.when(~is_accuracy, F.col("support")).alias("support"),
        F.when(is_accuracy, F.col("precision") >= ACCURACY_FLOOR).otherwise(inside).alias("ok"),
    )


_perceptrons: dict[tuple[str, str], perceptron.FileClassifier] = {}


def trained_perceptron(spark: SparkSession, sf: str) -> perceptron.FileClassifier:
    """The perceptron of all training rows, a tenth of which decide when to stop; fitted once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _perceptrons:
        train = split_corpus(spark, sf).where("split = 'train'")
        _perceptrons[key] = perceptron.train_perceptron(train, "doc_id")
    return _perceptrons[key]


def perceptron_report(spark: SparkSession, sf: str) -> DataFrame:
    held_out = split_corpus(spark, sf).where("split = 'validation'").withColumnRenamed("filename", "filepath")
    scored = perceptron.perceptron_scorer(trained_perceptron(spark, sf))(held_out)
    return class_report_full(scored.select(F.col("label").alias("y_true"), F.col("category").alias("y_pred")))


@query(
    "train_perceptron",
    f"""{_SPLIT_SQL} select label, cast(support as double) as support, true as ok, true as stop_ok from held_out
        union all select 'accuracy', null, true, true
        union all select name, (select cast(sum(support) as double) from held_out), true, true
          from (values ('macro avg'), ('weighted avg')) v(name)""",
)
def train_perceptron(spark: SparkSession, sf: str) -> DataFrame:
    """As ``train_classifier``, by mini-batches; and whether the training stopped where the scan over its history stops."""
    training = trained_perceptron(spark, sf).training
    stops = ev.early_stop(training.history, "run", "epoch", "val_macro_f1", perceptron.PATIENCE).select(
        ((F.col("best_epoch") == training.best_epoch) & (F.col("last_epoch") == training.last_epoch)).alias("stop_ok")
    )
    metrics = [F.col(m) for m in REPORT_METRICS]
    inside = reduce(lambda a, b: a & b, [m.between(0, 1) for m in metrics])
    is_accuracy = F.col("label") == "accuracy"
    return perceptron_report(spark, sf).select(
        "label",
        F.when(~is_accuracy, F.col("support")).alias("support"),
        F.when(is_accuracy, F.col("precision") > PERCEPTRON_FLOOR).otherwise(inside).alias("ok"),
        stops.scalar().alias("stop_ok"),
    )


@query(
    "model_evaluation",
    f"""{_SPLIT_SQL} select (select max(draws) from whole) as train_rows, sum(support)::bigint as validation_rows,
          'Docs,Finance,Logs,Study' as labels, sum(support)::bigint as matrix_total, true as accuracy_ok, true as loss_ok,
          true as errors_ok from held_out""",
)
def model_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Summary, matrix, loss and top errors of the trained model on held-out rows, in terms that SQL can state."""
    split = split_corpus(spark, sf)
    model = trained_model(spark, sf)
    labels = ops.model_labels(model)
    held_out = split.where("split = 'validation'").withColumnRenamed("filename", "filepath")
    scored = ops.model_scorer(model)(held_out).withColumn("filename", F.col("filepath"))
    rows = materialise(ev.evaluation_rows(scored, labels, "doc_id"), "evaluation-rows")
    totals = ev.full_summary(rows, split.where("split = 'train'").count(), labels)
    matrix = ev.confusion_matrix(rows, labels).select(F.aggregate(F.array(*labels), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    loss = ev.mean_loss(rows, "row_index", 16).first()
    shown = ev.top_errors(rows).count()
    return totals.select(
        "train_rows",
        "validation_rows",
        F.array_join("labels", ",").alias("labels"),
        F.lit(matrix.agg(F.sum("n")).first()[0]).alias("matrix_total"),
        (F.col("accuracy") >= ACCURACY_FLOOR).alias("accuracy_ok"),
        F.lit(0 <= loss["mean_row_loss"] < 1).alias("loss_ok"),
        (F.least("total_errors", F.lit(25)) == shown).alias("errors_ok"),
    )


@query("score_batch", f"{with_views('corpus')} select doc_id, true as known, true as in_range from corpus")
def score_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Whether every document gets a category of the model and a confidence above 0 and up to 1."""
    model = trained_model(spark, sf)
    scored = ops.model_scorer(model)(_files(spark, sf))
    return scored.select(
        "doc_id",
        F.col("category").isin(ops.model_labels(model)).alias("known"),
        ((F.col("confidence") > 0) & (F.col("confidence") <= 1)).alias("in_range"),
    )


@query(
    "hybrid_classify",
    f"""{with_views('corpus')}, {_RULED}
        select doc_id, filename as filepath, base as filename, ruled as category, rule_confidence::double as confidence,
          true as ok from ruled""",
)
def hybrid_classify(spark: SparkSession, sf: str) -> DataFrame:
    """Rules first, the model for the rest: what rules decide, and whether the model's records are in order."""
    model = trained_model(spark, sf)
    files = _files(spark, sf)
    records = ops.classify(files, ops.model_scorer(model), keep=["doc_id"])
    ruled = ops.with_rule(files.select("doc_id", "filepath")).select("doc_id", F.col(ops.RULE).isNotNull().alias("ruled"))
    known = F.col("category").isin([*ops.model_labels(model), DEFAULT_CATEGORY])
    of_rule = lambda name: F.when(F.col("ruled"), F.col(name)).alias(name)
    return records.join(ruled, "doc_id").select(
        "doc_id",
        "filepath",
        "filename",
        of_rule("category"),
        of_rule("confidence"),
        (F.col("ruled") | (known & F.col("confidence").between(0, 1))).alias("ok"),
    )
