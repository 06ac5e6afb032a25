"""Queries for metrics, on predictions with known errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.operators import evaluate
from opinara.operators.splits import with_class_weight
from opinara.queries import tables as t
from opinara.queries.registry import query, rounded

_P = t.PREDICTIONS
_PROBS = {x: f"prob_{x}" for x in t.LABELS}
_CLASSES = f"""{_P}, c AS (SELECT label, count(*) FILTER (actual = label AND predicted = label) AS tp, count(*) FILTER (actual = label) AS support,
    count(*) FILTER (predicted = label) AS called FROM preds, (VALUES ('negative'), ('neutral'), ('positive')) l(label) GROUP BY label),
  m AS (SELECT label, CASE WHEN called = 0 THEN 0 ELSE tp / called END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
    CASE WHEN called + support = 0 THEN 0 ELSE 2 * tp / (called + support) END AS f1, CAST(support AS DOUBLE) AS support FROM c),
  a AS (SELECT avg(CAST(actual = predicted AS INTEGER)) AS acc, CAST(count(*) AS DOUBLE) AS rows FROM preds)"""
_WEIGHTED = ", ".join(f"round(sum({x} * support) / sum(support), 6) AS {x}" for x in evaluate.METRICS)
_PLAIN = ", ".join(f"round(avg({x}), 6) AS {x}" for x in evaluate.METRICS)
_EACH = ", ".join(f"round({x}, 6) AS {x}" for x in evaluate.METRICS)


@query("m01_accuracy", f"WITH {_P} SELECT round(avg(CAST(actual = predicted AS INTEGER)), 6) AS accuracy FROM preds")
def m01(spark, sf):
    return rounded(evaluate.accuracy(t.predictions(spark, sf)))


@query("m02_weighted_scores", f"WITH {_CLASSES} SELECT (SELECT round(acc, 6) FROM a) AS accuracy, {_WEIGHTED} FROM m")
def m02(spark, sf):
    return rounded(evaluate.scores(t.predictions(spark, sf), t.LABELS))


@query("m03_class_scores", f"WITH {_CLASSES} SELECT label, {_EACH}, support FROM m")
def m03(spark, sf):
    return rounded(evaluate.class_scores(t.predictions(spark, sf), t.LABELS))


@query("m04_report", f"""WITH {_CLASSES} SELECT label, {_EACH}, support FROM m
  UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), rows FROM a
  UNION ALL SELECT 'macro avg', {_PLAIN}, sum(support) FROM m UNION ALL SELECT 'weighted avg', {_WEIGHTED}, sum(support) FROM m""")
def m04(spark, sf):
    return rounded(evaluate.report(t.predictions(spark, sf), t.LABELS))


@query("m05_confusion_matrix", f"""WITH {_P} SELECT actual, {', '.join(f"count(*) FILTER (predicted = '{x}') AS {x}" for x in t.LABELS)} FROM preds GROUP BY actual""")
def m05(spark, sf):
    return evaluate.confusion_matrix(t.predictions(spark, sf), t.LABELS)


_AUC = " UNION ALL ".join(
    f"""SELECT (sum(r) FILTER (actual = '{x}') - count(*) FILTER (actual = '{x}') * (count(*) FILTER (actual = '{x}') + 1) / 2.0)
      / (count(*) FILTER (actual = '{x}') * count(*) FILTER (actual <> '{x}')) AS auc FROM (SELECT actual, rank() OVER (ORDER BY prob_{x}) + (count(*) OVER (PARTITION BY prob_{x}) - 1) / 2.0 AS r FROM preds)"""
    for x in t.LABELS)


@query("m06_roc_auc", f"WITH {_P} SELECT round(avg(auc), 6) AS roc_auc FROM ({_AUC})")
def m06(spark, sf):
    return rounded(evaluate.roc_auc(t.predictions(spark, sf), _PROBS))


@query("m07_class_accuracy", f"WITH {_P} SELECT actual AS label, round(avg(CAST(actual = predicted AS INTEGER)), 6) AS accuracy FROM preds GROUP BY actual")
def m07(spark, sf):
    return rounded(evaluate.class_accuracy(t.predictions(spark, sf)))


def _majority(p):
    return p.withColumn("predicted", F.lit("positive"))


_MAJORITY = f"{_P}, q AS (SELECT actual, 'positive' AS predicted FROM preds)"


def _scores_sql(source: str, name: str) -> str:
    return f"""SELECT '{name}' AS model, (SELECT round(avg(CAST(actual = predicted AS INTEGER)), 6) FROM {source}) AS accuracy, {_WEIGHTED} FROM (
      SELECT CASE WHEN called = 0 THEN 0 ELSE tp / called END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
        CASE WHEN called + support = 0 THEN 0 ELSE 2 * tp / (called + support) END AS f1, support FROM (
        SELECT count(*) FILTER (actual = label AND predicted = label) AS tp, count(*) FILTER (actual = label) AS support, count(*) FILTER (predicted = label) AS called
        FROM {source}, (VALUES ('negative'), ('neutral'), ('positive')) l(label) GROUP BY label))"""


@query("m08_model_comparison", f"WITH {_MAJORITY} {_scores_sql('preds', 'shifted')} UNION ALL {_scores_sql('q', 'majority')}")
def m08(spark, sf):
    p = t.predictions(spark, sf)
    return rounded(evaluate.compare({"shifted": evaluate.scores(p, t.LABELS), "majority": evaluate.scores(_majority(p), t.LABELS)}))


@query("m08_best_model", f"WITH {_MAJORITY} SELECT * FROM ({_scores_sql('preds', 'shifted')} UNION ALL {_scores_sql('q', 'majority')}) ORDER BY accuracy DESC, model LIMIT 1")
def m08_best(spark, sf):
    p = t.predictions(spark, sf)
    return rounded(evaluate.best_model(evaluate.compare({"shifted": evaluate.scores(p, t.LABELS), "majority": evaluate.scores(_majority(p), t.LABELS)})))


_LOSS = "-ln(greatest(CASE actual WHEN 'negative' THEN prob_negative WHEN 'neutral' THEN prob_neutral ELSE prob_positive END, 1e-15))"


@query("m11_cross_entropy", f"WITH {_P} SELECT round(avg({_LOSS}), 6) AS loss FROM preds")
def m11(spark, sf):
    return rounded(evaluate.cross_entropy(t.predictions(spark, sf), _PROBS))


@query("m11_weighted_cross_entropy", f"""WITH {_P}, w AS (SELECT *, count(*) OVER () / (3 * count(*) OVER (PARTITION BY actual)) AS w FROM preds)
  SELECT round(sum({_LOSS} * w) / sum(w), 6) AS loss FROM w""")
def m11_weighted(spark, sf):
    return rounded(evaluate.cross_entropy(with_class_weight(t.predictions(spark, sf), "actual"), _PROBS, weight="class_weight"))
