"""Queries for models. Solvers differ between engines, so the SQL checks what must hold for any of them: the rows they
judge, the ranges of what they return, and the figures that do not depend on the solver."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from opinara.operators import evaluate, models, splits
from opinara.plans.experiment import Settings, best_length, pick_best, run, score_texts, text_pipeline
from opinara.queries import tables as t
from opinara.queries.registry import query, rounded

_BALANCED = {"class_weight": "balanced"}
_FOREST = {**_BALANCED, "n_estimators": 100, "max_depth": models.MAX_TREE_DEPTH}
#: Seconds of the last fit of each kind, for the bench.
FIT_SECONDS: dict[str, float] = {}

_SPLIT = f"""{t.LABELLED}, s AS (SELECT doc_id, label, CASE WHEN rn <= round(total * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || ':42')) AS rn, count(*) OVER (PARTITION BY label) AS total FROM comments))"""
_TEST_SIZES = f"WITH {_SPLIT} SELECT label, count(*) AS n_test, true AS valid FROM s WHERE split = 'test' GROUP BY label"


def _outcome(spark, sf, kind: str = "logistic_regression", params: dict | None = None, **settings):
    base = {"kind": kind, "params": params or {**_BALANCED, "max_iter": 1000}}
    outcome = run(t.labelled(spark, sf), "doc_id", "text", "label", t.LABELS, Settings(**{**base, **settings}))
    FIT_SECONDS[kind] = round(outcome.fitted.seconds, 3)
    return outcome


def _class_rows(outcome):
    """Test rows of each class, and whether all were predicted as some class with metrics between 0 and 1."""
    p = outcome.predictions
    sizes = p.groupBy(F.col("actual").alias("label")).agg(F.count("*").alias("n_test"), F.min(F.col("predicted").isin(t.LABELS)).alias("_known"))
    rows = outcome.report().select("label", *[F.col(m).between(0, 1).alias(m) for m in ("precision", "recall", "f1")])
    return sizes.join(rows, "label").select("label", "n_test", (F.col("_known") & F.col("precision") & F.col("recall") & F.col("f1")).alias("valid"))


#: Share of the slope of the loss that a finished fit may leave over; one iteration leaves more than half.
GRADIENT_LEFT = 0.1


@query("l01_logistic_regression", _TEST_SIZES.replace("true AS valid", "true AS valid, true AS converged"))
def l01(spark, sf):
    """Test rows of each class, and whether the weights are those of the least loss."""
    o = _outcome(spark, sf)
    return _class_rows(o).withColumn("converged", F.lit(o.gradient_left("label") <= GRADIENT_LEFT))


@query("l01_report")
def l01_report(spark, sf):
    """Precision, recall, F1 and support of every class and their means, accuracy and AUC, as the solver gives them."""
    o = _outcome(spark, sf)
    return o.report().select("*", o.scores().select("accuracy").scalar().alias("accuracy"), o.roc_auc().scalar().alias("roc_auc"),
                             F.lit(o.gradient_left("label")).alias("gradient_left"))


@query("l02_report")
def l02_report(spark, sf):
    return _outcome(spark, sf, "random_forest", _FOREST).report()


@query("l03_report")
def l03_report(spark, sf):
    return _outcome(spark, sf, "svc", {**_BALANCED, "max_iter": 1000}).report()


@query("l07_top_terms")
def l07_top_terms(spark, sf):
    """The ten largest coefficients of each class with their terms."""
    o = _outcome(spark, sf)
    return models.extreme_terms(models.coefficient_table(spark, o.fitted, o.feature_names), 10)


@query("l06_scored_texts")
def l06_scored_texts(spark, sf):
    """Class, confidence and probabilities of every document, as the solver gives them."""
    return score_texts(text_pipeline(_outcome(spark, sf)), t.table(spark, sf, "documents"), ["doc_id"], t.LABELS)


@query("m12_history")
def m12_history(spark, sf):
    """Loss of every iteration."""
    return models.loss_history(spark, _outcome(spark, sf).fitted)


@query("l02_random_forest", _TEST_SIZES)
def l02(spark, sf):
    return _class_rows(_outcome(spark, sf, "random_forest", _FOREST))


@query("l03_linear_svc", _TEST_SIZES)
def l03(spark, sf):
    return _class_rows(_outcome(spark, sf, "svc", {**_BALANCED, "max_iter": 1000}))


@query("l04_most_frequent_baseline", f"""WITH {_SPLIT}
  SELECT doc_id, label, (SELECT label FROM s WHERE split = 'train' GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) AS predicted FROM s WHERE split = 'test'""")
def l04(spark, sf):
    marked = splits.stratified_split(t.labelled(spark, sf).select("doc_id", "label"), "doc_id", "label", {"test": 0.2})
    test = marked.where("split = 'test'").drop("split")
    return models.most_frequent(marked.where("split = 'train'"), test, "label")


@query("l05_train_and_evaluate", _TEST_SIZES)
def l05(spark, sf):
    """Counts and numeric features, vectoriser fitted on all rows."""
    return _class_rows(_outcome(spark, sf, tfidf=False, numeric=True, fit_scope="all", min_df=1, max_df=1.0))


@query("l06_batch_scoring", "SELECT doc_id, 1.0::DOUBLE AS total, true AS valid FROM documents")
def l06(spark, sf):
    """Every document scored by the saved form of the model."""
    scored = score_texts(text_pipeline(_outcome(spark, sf)), t.table(spark, sf, "documents"), ["doc_id"], t.LABELS)
    probabilities = [F.col(f"prob_{x}") for x in t.LABELS]
    return scored.select(
        "doc_id", F.round(sum(probabilities[1:], probabilities[0]), 6).alias("total"),
        (F.col("predicted").isin(t.LABELS) & (F.col("confidence") == F.greatest(*probabilities)) & (F.least(*probabilities) >= 0)).alias("valid"))


def _half(low: int) -> str:
    return f"list_sum(list_transform(embedding[{low}:{low + 31}], lambda x: CAST(x AS DOUBLE)))"


@query("l06_external_model", f"""WITH h AS (SELECT vec_id, {_half(1)} AS a, {_half(33)} AS b FROM embeddings)
  SELECT vec_id, round(1 / (1 + exp(b - a)), 6) AS prob_first, round(1 / (1 + exp(a - b)), 6) AS prob_second, CASE WHEN a >= b THEN 'first' ELSE 'second' END AS predicted FROM h""")
def l06_external(spark, sf):
    """A user-supplied batch model over the embedding column."""
    def make_predict():
        import numpy as np

        def predict(batch):
            halves = np.stack([batch[:, :32].sum(axis=1), batch[:, 32:].sum(axis=1)], axis=1)
            odds = np.exp(halves - halves.max(axis=1, keepdims=True))
            return odds / odds.sum(axis=1, keepdims=True)

        return predict

    rows = t.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rounded(models.score_external(rows, "embedding", 64, make_predict, ["first", "second"]).drop("embedding", "label"), 6)


@query("l07_coefficients", f"WITH {t.LABELLED} SELECT DISTINCT label AS class, CAST(unnest(range(1, 11)) AS INTEGER) AS rank, true AS valid FROM comments")
def l07(spark, sf):
    o = _outcome(spark, sf)
    best = models.extreme_terms(models.coefficient_table(spark, o.fitted, o.feature_names), 10)
    vocabulary = spark.createDataFrame([(x,) for x in o.feature_names], "term string")
    known = best.join(vocabulary.withColumn("_known", F.lit(True)), "term", "left")
    return known.select("class", "rank", F.coalesce("_known", F.lit(False)).alias("valid"))


@query("l07_importances", f"WITH {t.LABELLED} SELECT count(DISTINCT doc_id) > 0 AS valid, CAST(20 AS BIGINT) AS n FROM comments")
def l07_importances(spark, sf):
    """The twenty largest importances: all positive shares of one."""
    o = _outcome(spark, sf, "random_forest", _FOREST)
    top = models.top_importances(models.importance_table(spark, o.fitted, o.feature_names))
    return top.agg(((F.min("value") >= 0) & (F.sum("value") <= 1 + 1e-9)).alias("valid"), F.count("*").alias("n"))


@query("l08_sample_predictions", f"""WITH {t.PREDICTIONS}, s AS (SELECT * FROM preds ORDER BY md5(doc_id || ':42') LIMIT 10),
  b AS (SELECT s.*, CASE greatest(prob_negative, prob_neutral, prob_positive) WHEN prob_negative THEN 'negative' WHEN prob_neutral THEN 'neutral' ELSE 'positive' END AS best FROM s)
  SELECT b.doc_id, CASE WHEN length(d.text) > 100 THEN left(d.text, 100) || '...' ELSE d.text END AS text, actual, best AS predicted,
    printf('%.3f', greatest(prob_negative, prob_neutral, prob_positive)) AS confidence, actual = best AS correct FROM b JOIN documents d ON d.doc_id = b.doc_id""")
def l08(spark, sf):
    return models.sample_predictions(t.predictions(spark, sf), t.table(spark, sf, "documents"), "doc_id", "text", t.LABELS)


@query("l09_best_on_validation", f"WITH {_SPLIT} SELECT 'C=' || c AS model, count(*) AS n_test, true AS valid FROM s, (VALUES ('0.1'), ('1.0'), ('10.0')) v(c) WHERE split = 'test' GROUP BY c")
def l09(spark, sf):
    """Three regularisation strengths; the chosen one has the largest accuracy of the comparison."""
    candidates = {f"C={c}": Settings(params={**_BALANCED, "C": c, "max_iter": 1000}) for c in (0.1, 1.0, 10.0)}
    best, outcome, table = pick_best(t.labelled(spark, sf), "doc_id", "text", "label", t.LABELS, candidates)
    n_test = outcome.predictions.agg(F.count("*").alias("n"))
    top = table.agg(F.max("accuracy").alias("a"))
    first = table.where(F.col("model") == best).select("accuracy")
    return table.select("model", n_test.scalar().alias("n_test"), (first.scalar() == top.scalar()).alias("valid"))


@query("l09_history")
def l09_history(spark, sf):
    """Loss and validation accuracy of fits of growing length, and the one that is kept."""
    return best_length(t.labelled(spark, sf), "doc_id", "text", "label", t.LABELS, Settings(params=_BALANCED))[1]


@query("m10_training_time", f"WITH {_SPLIT} SELECT 'logistic_regression' AS model, true AS positive, count(*) FILTER (split = 'test') AS n_test FROM s")
def m10(spark, sf):
    o = _outcome(spark, sf)
    return o.predictions.agg(F.count("*").alias("n_test")).select(
        F.lit(o.fitted.kind).alias("model"), F.lit(o.fitted.seconds > 0).alias("positive"), "n_test")


@query("m12_training_history", f"WITH {t.LABELLED} SELECT count(*) > 0 AS falls FROM comments")
def m12(spark, sf):
    """The loss never rises, and ends below its start."""
    history = models.loss_history(spark, _outcome(spark, sf).fitted)
    next_ = F.lead("loss").over(Window.orderBy("iteration"))
    steps = history.select("iteration", "loss", next_.alias("_next"))
    return steps.agg(((F.max(F.col("_next") - F.col("loss")) <= 1e-9) & (F.max_by("loss", "iteration") < F.min_by("loss", "iteration"))).alias("falls"))


@query("m09_model_against_baseline", f"""WITH {_SPLIT}, g AS (SELECT label FROM s WHERE split = 'train' GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
  SELECT 'baseline' AS model, round(avg(CAST(label = (SELECT label FROM g) AS DOUBLE)), 4) AS accuracy, true AS valid FROM s WHERE split = 'test'
  UNION ALL SELECT 'logistic_regression', NULL, true""")
def m09(spark, sf):
    """The baseline's accuracy follows from the split; the model's is only checked for its range."""
    o = _outcome(spark, sf)
    table = evaluate.compare({"baseline": o.baseline_scores("label"), o.fitted.kind: o.scores()})
    return table.select("model", F.when(F.col("model") == "baseline", F.round("accuracy", 4)).alias("accuracy"),
                        (F.col("accuracy").between(0, 1) & F.col("f1").between(0, 1)).alias("valid"))
