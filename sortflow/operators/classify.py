"""Classification: file-name rules first, a model for the rest, low confidence rejected."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StringIndexer, StringIndexerModel, UnivariateFeatureSelector
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sortflow.functions.labels import arg_max, category_icon, reject_low, softmax
from sortflow.functions.paths import base_name, featurize_name, names_any_suffix, suffix_part
from sortflow.functions.text import result_preview
from sortflow.functions.vocabulary import (
    DEFAULT_CATEGORY,
    EXTENSION_RULES,
    REJECT_THRESHOLD,
    SEED,
)
from sortflow.operators.features import FEATURE_BLOCKS, Block, fit_feature_stages
from sortflow.plans.once import computed_once
from sortflow.plans.workspace import materialise

PREDICTION_COLUMNS = ["filepath", "filename", "category", "icon", "confidence", "content_preview"]

Scorer = Callable[[DataFrame], DataFrame]


# --- rules ------------------------------------------------------------------------------------------


RULE = "__rule"


def with_rule(df: DataFrame) -> DataFrame:
    """Add the category by suffix, null if no rule applies."""
    named = computed_once(df, df.columns, {"__part": suffix_part(F.col("filepath"))})
    category = F.lit(None).cast("string")
    for name, _, suffixes in reversed(EXTENSION_RULES):
        category = F.when(names_any_suffix(F.col("__part"), suffixes), name).otherwise(category)
    return computed_once(named, df.columns, {RULE: category})


def rule_confidence(category: Column) -> Column:
    result = F.lit(None).cast("double")
    for name, confidence, _ in EXTENSION_RULES:
        result = F.when(category == name, F.lit(confidence)).otherwise(result)
    return result


def prediction_record(df: DataFrame, threshold: float, *keep: str) -> DataFrame:
    """The six-field record, plus the ``keep`` columns, from filepath, category, confidence and preview.

    A missing confidence means that scoring failed: default category, 0, no preview.
    """
    failed = F.col("confidence").isNull() | F.isnan("confidence") | F.col("category").isNull()
    category = F.when(failed, DEFAULT_CATEGORY).otherwise(
        reject_low(F.col("category"), F.col("confidence"), threshold)
    )
    return df.select(
        *keep,
        "filepath",
        base_name(F.col("filepath")).alias("filename"),
        category.alias("category"),
        category_icon(category).alias("icon"),
        F.when(failed, 0.0).otherwise(F.round("confidence", 3)).alias("confidence"),
        F.when(failed, "").otherwise(F.col("content_preview")).alias("content_preview"),
    )


def classify_by_rule(df: DataFrame, *keep: str) -> DataFrame:
    """Records of the rows that a rule decides. Content is not read."""
    hits = with_rule(df.select(*keep, "filepath")).where(F.col(RULE).isNotNull()).withColumnRenamed(RULE, "category")
    return prediction_record(
        hits.withColumn("confidence", rule_confidence(F.col("category"))).withColumn("content_preview", F.lit("")),
        0.0,
        *keep,
    )


def classify(df: DataFrame, scorer: Scorer, threshold: float = REJECT_THRESHOLD, keep: Sequence[str] = ()) -> DataFrame:
    """Records for every row of (filepath, content, *keep).

    The frame is split on the rule, so that only undecided rows reach the
    scorer; a scorer adds ``category`` and unrounded ``confidence``.
    """
    undecided = with_rule(df).where(F.col(RULE).isNull()).drop(RULE)
    scored = scorer(undecided).withColumn("content_preview", result_preview(F.col("content")))
    return classify_by_rule(df, *keep).unionByName(prediction_record(scored, threshold, *keep))


def classify_in_place(
    df: DataFrame, category: Column, confidence: Column, threshold: float = REJECT_THRESHOLD, keep: Sequence[str] = ()
) -> DataFrame:
    """As :func:`classify`, for a score that is a column expression: one pass, usable on streams."""
    ruled = F.col(RULE).isNotNull()
    rows = with_rule(df).withColumn(
        "category", F.when(ruled, F.col(RULE)).otherwise(reject_low(category, confidence, threshold))
    ).withColumn("content_preview", F.when(ruled, "").otherwise(result_preview(F.col("content"))))
    rows = rows.withColumn(
        "confidence", F.when(ruled, rule_confidence(F.col(RULE))).otherwise(confidence)
    )
    return prediction_record(rows, 0.0, *keep)


# --- scores -----------------------------------------------------------------------------------------


def softmax_prediction(df: DataFrame, logits: str, labels: Sequence[str]) -> DataFrame:
    """Add category, confidence and the full label -> probability map of an array of logits."""
    names = F.array(*[F.lit(x) for x in labels])
    with_probabilities = df.withColumn("__p", softmax(F.col(logits)))
    return with_probabilities.select(
        *df.columns,
        F.coalesce(F.get(names, arg_max(F.col("__p")).cast("int")), F.lit(DEFAULT_CATEGORY)).alias("category"),
        F.array_max("__p").alias("confidence"),
        F.map_from_arrays(names, F.col("__p")).alias("probabilities"),
    )


def model_labels(model: PipelineModel) -> list[str]:
    for stage in model.stages:
        if isinstance(stage, StringIndexerModel):
            return list(stage.labels)
    raise ValueError("No stage of this model knows labels.")


def model_scorer(model: PipelineModel) -> Scorer:
    """Scorer of a fitted classifier over (filepath, content)."""
    stages = PipelineModel([s for s in model.stages if not isinstance(s, StringIndexerModel)])
    return scorer_of(stages, vector_to_array("probability"), model_labels(model))


def scorer_of(stages: PipelineModel, probabilities: Column, labels: Sequence[str]) -> Scorer:
    """Scorer by fitted stages over (filename, content) and a column of what they add."""
    names = F.array(*[F.lit(x) for x in labels])

    def score(df: DataFrame) -> DataFrame:
        # The model's input columns, never null, take the place of those of the frame for as long as it runs.
        kept = {c: {"filename": "__own_name", "content": "__own_content"}.get(c, c) for c in df.columns}
        inputs = df.withColumnsRenamed(kept).withColumns(
            {
                "filename": F.coalesce(featurize_name(base_name(F.col("filepath"))), F.lit("")),
                "content": F.coalesce("__own_content", F.lit("")),
            }
        )
        scored = stages.transform(inputs).withColumn("__p", probabilities)
        return scored.select(
            *[F.col(name).alias(c) for c, name in kept.items()],
            F.get(names, arg_max(F.col("__p")).cast("int")).alias("category"),
            F.array_max("__p").alias("confidence"),
            F.col("__p").alias("probabilities"),
        )

    return score


def external_scorer(
    make_predict_fn: Callable, column: str, width: int, labels: Sequence[str], batch_size: int = 1024
) -> Scorer:
    """Scorer of any model that maps a batch of float vectors to class probabilities.

    ``make_predict_fn`` runs once per Python worker; batches travel as Arrow.
    """
    names = F.array(*[F.lit(x) for x in labels])
    predict = predict_batch_udf(
        make_predict_fn,
        return_type=T.ArrayType(T.FloatType()),
        batch_size=batch_size,
        input_tensor_shapes=[[width]],
    )

    def score(df: DataFrame) -> DataFrame:
        scored = df.withColumn("__p", predict(F.col(column)))
        return scored.select(
            *df.columns,
            F.coalesce(F.get(names, arg_max(F.col("__p")).cast("int")), F.lit(DEFAULT_CATEGORY)).alias("category"),
            F.array_max("__p").cast("double").alias("confidence"),
        )

    return score


# --- training ---------------------------------------------------------------------------------------


def train_classifier(
    corpus: DataFrame,
    id_col: str,
    blocks: tuple[Block, ...] = FEATURE_BLOCKS,
    hidden: Sequence[int] = (256, 128),
    max_iter: int = 250,
    selected_features: int | None = None,
    algorithm: str = "mlp",
    seed: int = SEED,
) -> PipelineModel:
    """Fit features and classifier on (filename, content, label).

    ``selected_features`` keeps the features with the best F-test score; it is
    the lever on training cost of the perceptron, which grows with features x
    first layer; ``algorithm="logistic"`` takes all features as sparse vectors.
    The rows are written once, spread evenly, as the slowest partition sets the
    pace of each iteration; so are the features.
    """
    rows = corpus.select(id_col, featurize_name(F.col("filename")).alias("filename"), "content", "label")
    prepared = materialise(rows.repartition(id_col), "train-rows")
    indexer = StringIndexer(inputCol="label", outputCol="label_id", stringOrderType="alphabetAsc").fit(prepared)
    feature_stages = fit_feature_stages(prepared, id_col, blocks)
    vectors = materialise(
        indexer.transform(PipelineModel(feature_stages).transform(prepared)).select(
            "label_id", "features"
        ),
        "train-features",
    )
    stages: list[Model] = [*feature_stages]
    column, width = "features", len(vectors.first()["features"])
    if selected_features is not None and selected_features < width:
        selector = (
            UnivariateFeatureSelector(
                featuresCol="features", outputCol="selected", labelCol="label_id", selectionMode="numTopFeatures"
            )
            .setFeatureType("continuous")
            .setLabelType("categorical")
            .setSelectionThreshold(selected_features)
            .fit(vectors)
        )
        stages.append(selector)
        vectors = selector.transform(vectors)
        column, width = "selected", selected_features
    classes = len(indexer.labels)
    if algorithm == "mlp":
        estimator = MultilayerPerceptronClassifier(
            featuresCol=column, labelCol="label_id", layers=[width, *hidden, classes], maxIter=max_iter, seed=seed
        )
    elif algorithm == "logistic":
        estimator = LogisticRegression(featuresCol=column, labelCol="label_id", maxIter=max_iter, regParam=1e-4)
    else:
        raise ValueError(f"Unknown algorithm: {algorithm}")
    return PipelineModel([indexer, *stages, estimator.fit(vectors)])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
