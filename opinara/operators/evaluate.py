"""Classifier metrics as DataFrames.

Predictions are reduced to counts in one aggregation over the given labels; every metric is arithmetic on
that single row, so labels never predicted keep their row and column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.operators.prefix import with_prefix_sums
from opinara.operators.shaping import rows_from


def _counts(df: DataFrame, labels: list[str], actual: str, predicted: str) -> DataFrame:
    a, p = F.col(actual), F.col(predicted)
    aggregates = [F.count("*").alias("rows"), F.count_if(a == p).alias("hits")]
    for i, label in enumerate(labels):
        aggregates += [
            F.count_if((a == label) & (p == label)).alias(f"tp{i}"),
            F.count_if(a == label).alias(f"support{i}"),
            F.count_if(p == label).alias(f"predicted{i}"),
        ]
    return df.agg(*aggregates)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a * 1.0, b), F.lit(0.0))


def _class_metrics(i: int) -> dict[str, Column]:
    tp, support, predicted = F.col(f"tp{i}"), F.col(f"support{i}"), F.col(f"predicted{i}")
    return {
        "precision": _ratio(tp, predicted), "recall": _ratio(tp, support),
        "f1": _ratio(2 * tp, support + predicted), "support": support.cast("double"),
    }


def _mean(labels: list[str], metric: str, weighted: bool) -> Column:
    """Mean over classes; a class that is neither actual nor predicted takes no part in the plain mean."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for i in range(len(labels)):
        w = F.col(f"support{i}") if weighted else ((F.col(f"support{i}") + F.col(f"predicted{i}")) > 0).cast("int")
        total, weight = total + _class_metrics(i)[metric] * w, weight + w
    return _ratio(total, weight)


METRICS = ("precision", "recall", "f1")


def accuracy(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return df.agg(F.avg((F.col(actual) == F.col(predicted)).cast("int")).alias("accuracy"))


def scores(df: DataFrame, labels: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Accuracy with support-weighted precision, recall and F1, one row."""
    return _counts(df, labels, actual, predicted).select(
        _ratio(F.col("hits"), F.col("rows")).alias("accuracy"), *[_mean(labels, m, True).alias(m) for m in METRICS]
    )


def class_scores(df: DataFrame, labels: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return rows_from(_counts(df, labels, actual, predicted), [
        {"label": F.lit(label), **_class_metrics(i)} for i, label in enumerate(labels)
    ])


def report(df: DataFrame, labels: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Rows per class, then accuracy, macro mean and weighted mean."""
    rows = F.col("rows").cast("double")
    hit = _ratio(F.col("hits"), F.col("rows"))
    entries = [{"label": F.lit(label), **_class_metrics(i)} for i, label in enumerate(labels)]
    entries.append({"label": F.lit("accuracy"), "precision": hit, "recall": hit, "f1": hit, "support": rows})
    for name, weighted in (("macro avg", False), ("weighted avg", True)):
        entries.append({"label": F.lit(name), **{m: _mean(labels, m, weighted) for m in METRICS}, "support": rows})
    return rows_from(_counts(df, labels, actual, predicted), entries)


def confusion_matrix(df: DataFrame, labels: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """One row per actual label, one column per predicted label, zeros kept."""
    a, p = F.col(actual), F.col(predicted)
    cells = df.agg(*[
        F.count_if((a == x) & (p == y)).alias(f"c{i}_{j}")
        for i, x in enumerate(labels) for j, y in enumerate(labels)
    ])
    return rows_from(cells, [
        {"actual": F.lit(x), **{y: F.col(f"c{i}_{j}") for j, y in enumerate(labels)}} for i, x in enumerate(labels)
    ])


def class_accuracy(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(F.col(actual).alias("label")).agg(
        F.avg((F.col(actual) == F.col(predicted)).cast("int")).alias("accuracy")
    )


def roc_auc(df: DataFrame, probabilities: dict[str, str], actual: str = "actual") -> DataFrame:
    """Mean one-vs-rest area under the ROC curve; NULL when a class is absent or covers every row.

    Equal scores are first reduced to one row with their positives and negatives; running counts of
    negatives are then exact without a global sort.
    """
    known = F.col(actual).isNotNull()
    pairs = F.explode(F.array(*[
        F.struct(F.lit(label).alias("label"), F.col(c).cast("double").alias("score"),
                 (F.col(actual) == label).cast("long").alias("hit"))
        for label, c in probabilities.items()
    ]))
    points = df.where(known).select(pairs.alias("_p")).select("_p.*")
    points = points.groupBy("label", "score").agg(F.sum("hit").alias("pos"), F.sum(1 - F.col("hit")).alias("neg"))
    ranked = with_prefix_sums(points, ["label"], "score", ["neg", "pos"])
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") * 0.5))
    per_class = ranked.groupBy("label").agg(
        F.try_divide(won, F.max("pos_total").cast("double") * F.max("neg_total")).alias("auc")
    )
    complete = F.count("auc") == len(probabilities)
    return per_class.agg(F.when(complete, F.avg("auc")).alias("roc_auc"))


def cross_entropy(df: DataFrame, probabilities: dict[str, str], actual: str = "actual", weight: str | None = None) -> DataFrame:
    """Mean negative log probability of the true class, optionally weighted."""
    chain = F
    for label, c in probabilities.items():
        chain = chain.when(F.col(actual) == label, F.col(c))
    loss = -F.ln(F.greatest(chain, F.lit(1e-15)))
    if weight is None:
        return df.agg(F.avg(loss).alias("loss"))
    return df.agg(F.try_divide(F.sum(loss * F.col(weight)), F.sum(weight)).alias("loss"))


def compare(results: dict[str, DataFrame]) -> DataFrame:
    """One-row score tables of several models, best accuracy first, ties by name."""
    from opinara.operators.shaping import union_all

    named = [df.select(F.lit(name).alias("model"), "*") for name, df in results.items()]
    return union_all(*named, rank_column=None).orderBy(F.desc("accuracy"), "model")


def best_model(comparison: DataFrame, metric: str = "accuracy") -> DataFrame:
    return comparison.orderBy(F.desc(metric), "model").limit(1)
