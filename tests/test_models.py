import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.operators import evaluate, models, terms
from opinara.plans import experiment
from opinara.session import scratch_path
from opinara.sources import sinks

LABELS = ["negative", "neutral", "positive"]


@pytest.fixture(scope="module")
def texts(spark):
    words = {"negative": "awful broken mess", "neutral": "table chair window", "positive": "lovely bright result"}
    data = [(i, f"{words[LABELS[i % 3]]} item filler{i % 5}", LABELS[i % 3]) for i in range(120)]
    return spark.createDataFrame(data, "id long, text string, label string").repartition(3).cache()


def run(texts, kind, **more):
    settings = {"max_features": 200, "min_df": 1, "max_df": 1.0, "params": {"class_weight": "balanced", "max_iter": 30, "n_estimators": 10}, **more}
    return experiment.run(texts, "id", "text", "label", LABELS, experiment.Settings(kind=kind, **settings))


@pytest.mark.parametrize("kind", ["logistic_regression", "random_forest", "svc"])
def test_models_learn_separable_classes(spark, texts, kind):
    outcome = run(texts, kind, numeric=kind == "logistic_regression")
    row = outcome.scores().first()
    assert row["accuracy"] == 1.0 and row["f1"] == 1.0
    assert outcome.test.count() == 24 and outcome.predictions.count() == 24
    assert outcome.baseline_scores("label").first()["accuracy"] == pytest.approx(1 / 3)
    auc = outcome.roc_auc().first()[0]
    assert auc is None if kind == "svc" else auc == pytest.approx(1.0)
    if kind == "random_forest":
        top = models.top_importances(models.importance_table(spark, outcome.fitted, outcome.feature_names), 3).collect()
        assert len(top) == 3 and top[0]["value"] >= top[1]["value"]


def test_texts_are_measured_once_for_scaling(spark, monkeypatch):
    """Means and deviations come from written numbers; before, every text was counted for them and again for its row."""
    data = [(i, None if i == 7 else "word " * (i % 9) + f"filler{i % 5}", LABELS[i % 3]) for i in range(60)]
    df = spark.createDataFrame(data, "id long, text string, label string").repartition(3)
    scaled, scale = [], terms.scale
    monkeypatch.setattr(terms, "scale", lambda rows, columns: scaled.append(rows) or scale(rows, columns))
    made = experiment.features(df, "id", "text", "label", experiment.Settings(min_df=1, max_df=1.0, numeric=True, tfidf=False, fit_scope="all"))
    assert len(scaled) == 1 and scaled[0].inputFiles()
    rows = {r["id"]: r["features"].toArray()[-2:] for part in (made.train, made.test) for r in part.collect()}
    assert len(rows) == 60 and made.names[-2:] == ["text_length", "word_count"]
    lengths, counts = np.array([len(t or "") for _, t, _ in data], float), np.array([len((t or "").split()) for _, t, _ in data], float)
    lengths[7] = np.nan  # a text that is missing has no length
    assert [rows[i][1] for i in range(60)] == pytest.approx(list((counts - counts.mean()) / counts.std()))
    assert np.array([rows[i][0] for i in range(60)]) == pytest.approx((lengths - np.nanmean(lengths)) / np.nanstd(lengths), nan_ok=True)


def test_saved_pipeline_scores_new_text(spark, texts):
    outcome = run(texts, "logistic_regression")
    path = scratch_path(spark, "model")
    sinks.save_model(experiment.text_pipeline(outcome), path)
    new = spark.createDataFrame([(1, "what a lovely bright day"), (2, "awful mess"), (3, "")], "id long, text string")
    out = {r["id"]: r for r in experiment.score_texts(sinks.load_model(path), new, ["id"], LABELS).collect()}
    assert (out[1]["predicted"], out[2]["predicted"]) == ("positive", "negative")
    assert sum(out[1][f"prob_{x}"] for x in LABELS) == pytest.approx(1.0) and out[1]["confidence"] == max(out[1][f"prob_{x}"] for x in LABELS)
    extremes = models.extreme_terms(models.coefficient_table(spark, outcome.fitted, outcome.feature_names), 3)
    tops = {r["class"]: set() for r in extremes.collect()}
    for r in extremes.collect():
        tops[r["class"]].add(r["term"])
    assert tops["positive"] & {"lovely", "bright", "result", "lovely bright", "bright result"}
    history = [r["loss"] for r in models.loss_history(spark, outcome.fitted).orderBy("iteration").collect()]
    assert history[-1] < history[0]


@pytest.mark.parametrize("balanced", [True, False])
def test_gradient_shows_how_far_a_fit_got(spark, balanced):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    y = np.argmax(x[:, :3] + 0.8 * rng.normal(size=(200, 3)), axis=1) if balanced else (x[:, 0] > 0.9).astype(int)
    from pyspark.ml.linalg import Vectors

    train = spark.createDataFrame([(Vectors.dense(r), LABELS[c]) for r, c in zip(x.tolist(), y)], ["features", "label"])
    params = {"C": 0.7, **({"class_weight": "balanced"} if balanced else {})}
    left = []
    for steps in (1, 3, 200):
        fitted = models.fit(train, "logistic_regression", LABELS, "label", {**params, "max_iter": steps, "tol": 1e-12})
        end, start = models.gradient_norms(fitted, train, "label", params)
        w, b = fitted.classifier.coefficientMatrix.toArray(), fitted.classifier.interceptVector.toArray()
        weight = np.array([200 / (len(set(y)) * (y == c).sum()) for c in y]) if balanced else np.ones(200)

        def gradient(w, b, reg):
            z = np.exp(x @ w.T + b)
            r = (z / z.sum(axis=1, keepdims=True) - np.eye(len(w))[y]) * weight[:, None] / weight.sum()
            return np.linalg.norm(np.hstack([r.T @ x + reg * w, r.sum(axis=0)[:, None]]))

        assert end == pytest.approx(gradient(w, b, 1 / (0.7 * 200)), rel=1e-6, abs=1e-9)
        assert start == pytest.approx(gradient(0 * w, 0 * b, 0), rel=1e-6)
        left.append(end / start)
    assert left[0] > 0.05 and left[2] < 1e-4


def test_best_length_is_that_of_a_fresh_fit(spark, texts):
    settings = experiment.Settings(max_features=200, min_df=1, max_df=1.0, params={"class_weight": "balanced", "tol": 1e-9})
    outcome, history = experiment.best_length(texts, "id", "text", "label", LABELS, settings, lengths=(1, 2, 3, 5, 50), patience=2)
    rows = history.orderBy("length").collect()
    assert [r["length"] for r in rows] == [1, 2, 3, 5, 50][:len(rows)] and sum(r["chosen"] for r in rows) == 1
    best = next(r for r in rows if r["chosen"])
    assert best["validation_accuracy"] == max(r["validation_accuracy"] for r in rows)
    assert all(a["loss"] >= b["loss"] for a, b in zip(rows, rows[1:]))
    later = [r for r in rows if r["length"] > best["length"]]
    assert len(later) <= 2 and all(r["validation_accuracy"] <= best["validation_accuracy"] for r in later)
    fresh = models.fit(outcome.train, "logistic_regression", LABELS, "label", {**settings.params, "max_iter": best["length"]})
    assert np.allclose(fresh.classifier.coefficientMatrix.toArray(), outcome.fitted.classifier.coefficientMatrix.toArray())
    assert outcome.test.count() == 24 and outcome.predictions.count() == 24 and outcome.train.count() < 96
    # The first iterations of a longer fit are a shorter one.
    longer = models.fit(outcome.train, "logistic_regression", LABELS, "label", {**settings.params, "max_iter": 5})
    steps = longer.classifier.summary.objectiveHistory
    assert all(r["loss"] == pytest.approx(steps[r["iterations"]]) for r in rows if r["iterations"] < len(steps))


def test_best_candidate_is_picked(texts):
    weak = experiment.Settings(max_features=1, min_df=1, max_df=1.0, params={"max_iter": 1})
    strong = experiment.Settings(max_features=200, min_df=1, max_df=1.0, params={"max_iter": 30})
    best, outcome, table = experiment.pick_best(texts, "id", "text", "label", LABELS, {"weak": weak, "strong": strong})
    assert best == "strong" and [r["model"] for r in table.collect()] == ["strong", "weak"]


def test_tfidf_rows_have_unit_norm_and_known_weights(spark):
    docs = spark.createDataFrame([(0, "apple apple pear"), (1, "apple plum"), (2, "the of")], "id long, text string")
    table = terms.tfidf_table(docs, "id", "text", 10, 1, 1.0, ["the", "of"], ngrams=1).collect()
    assert {r["id"] for r in table} == {0, 1}
    got = {(r["id"], r["term"]): r["weight"] for r in table}
    apple, pear = 2 * (math.log(4 / 3) + 1), math.log(4 / 2) + 1
    assert got[(0, "apple")] == pytest.approx(apple / math.hypot(apple, pear))
    for i in (0, 1):
        assert sum(w * w for (d, _), w in got.items() if d == i) == pytest.approx(1.0)


def test_vocabulary_ties_and_order(spark):
    docs = spark.createDataFrame([(0, "bb aa cc"), (1, "bb aa dd")], "id long, text string")
    out = terms.vocabulary(docs, "text", 3, ngrams=1).orderBy("index").collect()
    assert [(r["index"], r["term"], r["n"]) for r in out] == [(0, "aa", 2), (1, "bb", 2), (2, "cc", 1)]
    pairs = terms.vocabulary(docs, "text", 10, min_df=2, ngrams=2)
    assert [r["term"] for r in pairs.orderBy("index").collect()] == ["aa", "bb", "bb aa"]


def test_scaling_matches_population_deviation(spark):
    values = [1.0, 4.0, 7.0, 8.0]
    out = terms.scale(spark.createDataFrame([(v, 2.0) for v in values], "a double, b double"), ["a", "b"]).orderBy("a").collect()
    assert [r["a_scaled"] for r in out] == pytest.approx(list((np.array(values) - 5) / np.std(values)))
    assert [r["b_scaled"] for r in out] == [0.0] * 4


def test_external_model(spark):
    rows = spark.createDataFrame([(1, [0.0, 3.0]), (2, [2.0, 1.0])], "id int, v array<double>")

    def make_predict():
        return lambda batch: batch / batch.sum(axis=1, keepdims=True)

    out = {r["id"]: r for r in models.score_external(rows, "v", 2, make_predict, ["a", "b"]).collect()}
    assert (out[1]["predicted"], out[2]["predicted"]) == ("b", "a") and out[2]["prob_a"] == pytest.approx(2 / 3)


def test_sample_predictions_without_probabilities(spark, texts):
    p = texts.select("id", F.col("label").alias("actual"), F.lit("neutral").alias("predicted"))
    out = models.sample_predictions(p, texts, "id", "text", LABELS, n=4, width=5).collect()
    assert len(out) == 4 and all(r["confidence"] == "N/A" and r["text"].endswith("...") for r in out)
    assert all(r["correct"] == (r["actual"] == "neutral") for r in out)


def test_weighted_loss(spark):
    p = spark.createDataFrame([("a", 0.5, 0.5, 1.0), ("b", 0.25, 0.75, 3.0)], "actual string, prob_a double, prob_b double, w double")
    probs = {"a": "prob_a", "b": "prob_b"}
    a, b = -math.log(0.5), -math.log(0.75)
    assert evaluate.cross_entropy(p, probs).first()[0] == pytest.approx((a + b) / 2)
    assert evaluate.cross_entropy(p, probs, weight="w").first()[0] == pytest.approx((a + 3 * b) / 4)


def test_depth_and_labels_are_checked(spark, texts):
    for depth in (None, 50):
        with pytest.raises(ValueError):
            run(texts, "random_forest", params={"max_depth": depth, "n_estimators": 2})
    with pytest.raises(Exception, match="label not listed"):
        experiment.run(texts, "id", "text", "label", LABELS[:2], experiment.Settings(max_features=50, min_df=1, max_df=1.0))


def test_accents_are_stripped_from_terms(spark):
    docs = spark.createDataFrame([(0, "Café naïve cafe ÉTÉ"), (1, "cafe\u0301 plain")], "id long, text string")
    table = terms.vocabulary(docs, "text", 20, ngrams=1)
    assert {(r["term"], r["n"]) for r in table.collect()} == {("cafe", 3), ("naive", 1), ("ete", 1), ("plain", 1)}
    model = terms.fit_terms(docs, "text", 20, 1, 1.0, ["a\\b", "it's", "plain"], 1, tfidf=False)
    assert set(model.terms) == {"cafe", "naive", "ete"}
    counts = {(r["id"], model.terms[r["index"]]): r["weight"] for r in terms.sparse_entries(model.transform(docs), "id", model.output).collect()}
    assert counts == {(0, "cafe"): 2.0, (0, "naive"): 1.0, (0, "ete"): 1.0, (1, "cafe"): 1.0}
    assert {"the", "of"} <= set(terms.default_stop_words())
