"""Classifiers, their scores per row and their coefficients as tables."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.functions.text import truncate
from opinara.operators import forest
from opinara.operators.joins import prediction_text
from opinara.operators.limits import ranked_per_group, sample_rows
from opinara.operators.splits import with_class_weight

KINDS = ("logistic_regression", "random_forest", "svc", "baseline")
MAX_TREE_DEPTH = 30
PARALLEL_FITS = 4
#: Relative change of the loss at which the linear solvers stop before their last iteration.
TOLERANCE = 1e-4


@dataclass
class Fitted:
    """A trained classifier: stages from features to ``predicted`` and how long the fit took."""

    kind: str
    labels: list[str]
    stages: PipelineModel
    seconds: float

    @property
    def classifier(self):
        return self.stages.stages[-2]

    @property
    def has_probability(self) -> bool:
        return self.kind != "svc"


def _estimator(kind: str, params: dict, n_rows: int, weight: str | None):
    common = {"featuresCol": "features", "labelCol": "label_index"}
    if weight:
        common["weightCol"] = weight
    if kind == "logistic_regression":
        return LogisticRegression(
            family="multinomial", maxIter=params.get("max_iter", 1000), tol=params.get("tol", TOLERANCE), standardization=False,
            regParam=1.0 / (params.get("C", 1.0) * n_rows),
            elasticNetParam=1.0 if params.get("penalty") == "l1" else 0.0, **common,
        )
    if kind == "random_forest":
        depth = params.get("max_depth", MAX_TREE_DEPTH)
        if depth is None or depth > MAX_TREE_DEPTH:
            raise ValueError(f"trees are at most {MAX_TREE_DEPTH} deep; ask for that depth or less")
        return RandomForestClassifier(
            numTrees=params.get("n_estimators", 100), maxDepth=depth,
            minInstancesPerNode=params.get("min_samples_leaf", 1), seed=params.get("seed", 42),
            cacheNodeIds=True, **common,  # forest.fit takes its parameters from here, and keeps the node of each row, too
        )
    if kind == "svc":
        machine = LinearSVC(
            maxIter=params.get("max_iter", 1000), tol=params.get("tol", TOLERANCE), standardization=False,
            regParam=1.0 / (params.get("C", 1.0) * n_rows), **common,
        )
        return OneVsRest(classifier=machine, parallelism=PARALLEL_FITS, **common)
    raise ValueError(f"unknown model kind {kind!r}")


def fit(train: DataFrame, kind: str, labels: list[str], label: str, params: dict | None = None) -> Fitted:
    """Train on a table with a ``features`` vector; labels are indexed in the given order.

    ``partitions`` among the parameters sets how many tasks work on the training rows in each iteration; by default
    they stay as they are. A label that is not listed raises an error.
    """
    params = params or {}
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label))
    unknown = F.raise_error(F.concat(F.lit("label not listed: "), F.coalesce(F.col(label), F.lit("NULL"))))
    rows = train.withColumn("label_index", F.when(place > 0, (place - 1).cast("double")).otherwise(unknown.cast("double")))
    weight = None
    if params.get("class_weight") == "balanced":
        rows, weight = with_class_weight(rows, label), "class_weight"
    rows = rows.select("features", "label_index", *([weight] if weight else []))
    rows = (rows.coalesce(params["partitions"]) if params.get("partitions") else rows).persist()
    try:
        n_rows = rows.count()
        started = time.perf_counter()
        estimator = _estimator(kind, params, n_rows, weight)
        model = forest.fit(rows, estimator) if kind == "random_forest" else estimator.fit(rows)
        seconds = time.perf_counter() - started
    finally:
        rows.unpersist()
    decode = IndexToString(inputCol="prediction", outputCol="predicted", labels=labels)
    return Fitted(kind, labels, PipelineModel([model, decode]), seconds)


def probability_columns(labels: list[str], probability: str = "probability") -> dict[str, Column]:
    values = vector_to_array(probability)
    return {f"prob_{label}": F.get(values, F.lit(i)) for i, label in enumerate(labels)}


def predict(fitted: Fitted, df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``predicted`` and, where the model has them, class probabilities."""
    scored = fitted.stages.transform(df)
    extra = probability_columns(fitted.labels) if fitted.has_probability else {}
    return scored.select(*keep, "predicted", *[c.alias(n) for n, c in extra.items()])


def most_frequent(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Test rows with the most frequent training label as prediction, ties by label."""
    best = train.groupBy(label).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), label).limit(1)
    return test.withColumn("predicted", best.select(label).scalar())


def class_probabilities(labels: list[str]) -> Column:
    """Map of class to probability from the ``prob_`` columns."""
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.array(*[F.col(f"prob_{x}") for x in labels]))


def best_class(labels: list[str]) -> Column:
    """Class with the largest probability, the first one on a tie."""
    top = F.greatest(*[F.col(f"prob_{x}") for x in labels])
    chain = F
    for x in labels:
        chain = chain.when(F.col(f"prob_{x}") == top, F.lit(x))
    return chain


def sample_predictions(
    predictions: DataFrame, originals: DataFrame, key: str, text: str, labels: list[str], n: int = 10, seed: int = 42,
    width: int = 100,
) -> DataFrame:
    """Sampled predictions with shortened text, confidence and whether they are right."""
    sampled = sample_rows(predictions, key, n, seed)
    shown = prediction_text(sampled, originals, key, text)
    if f"prob_{labels[0]}" in predictions.columns:
        chosen = best_class(labels)
        confidence = F.format_string("%.3f", F.bround(F.greatest(*[F.col(f"prob_{x}") for x in labels]), 3))
    else:
        chosen, confidence = F.col("predicted"), F.lit("N/A")
    return shown.select(
        key, truncate("text", width).alias("text"), "actual", chosen.alias("predicted"), confidence.alias("confidence"),
        (F.col("actual") == chosen).alias("correct"),
    )


def coefficient_table(spark: SparkSession, fitted: Fitted, terms: list[str]) -> DataFrame:
    """``(class, term, value)`` of a logistic regression; the size is classes times vocabulary."""
    matrix = fitted.classifier.coefficientMatrix.toArray()
    rows = [(label, term, float(v)) for label, line in zip(fitted.labels, matrix) for term, v in zip(terms, line)]
    return spark.createDataFrame(rows, "class string, term string, value double")


def importance_table(spark: SparkSession, fitted: Fitted, terms: list[str]) -> DataFrame:
    values = fitted.classifier.featureImportances.toArray()
    return spark.createDataFrame([(t, float(v)) for t, v in zip(terms, values)], "term string, value double")


def extreme_terms(table: DataFrame, k: int, largest: bool = True) -> DataFrame:
    """The k largest or smallest coefficients of each class, ties by term."""
    order = F.desc("value") if largest else F.asc("value")
    return ranked_per_group(table, ["class"], [order, F.asc("term")], k)


def top_importances(table: DataFrame, k: int = 20) -> DataFrame:
    return table.orderBy(F.desc("value"), "term").limit(k)


def gradient_norms(fitted: Fitted, train: DataFrame, label: str, params: dict) -> tuple[float, float]:
    """Length of the gradient of the regularised loss of a logistic regression: at its weights, and at no weights.

    The loss has one minimum, where the gradient is zero, so the first over the second tells how far the solver got,
    whatever it reports itself. One pass adds up residual times features of every class; the driver gets one number
    per class and feature, as many as the model has weights.
    """
    import numpy as np
    from pyspark.ml.stat import Summarizer

    rows, weight = train, F.lit(1.0)
    if params.get("class_weight") == "balanced":
        rows = with_class_weight(rows, label)
        weight = F.col("class_weight")
    scored = fitted.classifier.transform(rows.select("features", F.col(label).alias("_y"), weight.alias("_w")))
    values = vector_to_array("probability")
    weights = fitted.classifier.coefficientMatrix.toArray()
    labels = fitted.labels[:len(weights)]  # the last classes may not occur in training

    def summed(part):
        return Summarizer.metrics("sum").summary(F.col("features"), part)

    sums = [F.sum("_w").alias("total"), F.count("*").alias("n"), summed(F.col("_w")).alias("all")]
    for i, name in enumerate(labels):
        actual = (F.col("_y") == name).cast("double")
        for at, chance in (("end", F.get(values, F.lit(i))), ("start", F.lit(1 / len(labels)))):
            residual = (chance - actual) * F.col("_w")
            # Weights of a vector sum cannot be negative, so residuals are raised, and what that adds is taken off.
            sums += [F.sum(residual).alias(f"{at}_{i}"), summed(residual + F.col("_w")).alias(f"{at}_{i}_raised")]
    found = scored.agg(*sums).first()
    penalty = 1.0 / (params.get("C", 1.0) * found["n"]) * weights

    def length(at: str, extra) -> float:
        lines = []
        for i in range(len(labels)):
            slope = found[f"{at}_{i}_raised"]["sum"].toArray() - found["all"]["sum"].toArray()
            lines.append(np.append(slope / found["total"] + extra[i], found[f"{at}_{i}"] / found["total"]))
        return float(np.linalg.norm(lines))

    return length("end", penalty), length("start", 0 * penalty)


def loss_history(spark: SparkSession, fitted: Fitted) -> DataFrame:
    """Training objective per iteration, as recorded by the optimiser."""
    history = fitted.classifier.summary.objectiveHistory
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(history)], "iteration int, loss double")


def score_external(
    df: DataFrame, inputs: str, width: int, make_predict, labels: list[str], batch_size: int = 64
) -> DataFrame:
    """Score rows that hold an array of ``width`` numbers with a user-supplied batch model.

    ``make_predict`` is called once per Python worker and returns a function from a 2-D array to a 2-D array
    of class probabilities. Adds ``prob_`` columns and ``predicted``.
    """
    from pyspark.ml.functions import predict_batch_udf

    scorer = predict_batch_udf(
        make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=[[width]]
    )
    scored = df.withColumn("_p", scorer(inputs))
    named = scored.select(*df.columns, *[F.get("_p", F.lit(i)).alias(f"prob_{x}") for i, x in enumerate(labels)])
    return named.withColumn("predicted", best_class(labels))
