"""Train and evaluate one classifier on a table of texts and labels."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions import text as text_functions
from opinara.operators import evaluate, models, splits, terms
from opinara.operators.sizing import measured


@dataclass
class Settings:
    """Parameters of a run.

    ``fit_scope`` is ``train`` to fit the vectoriser on training rows only, or ``all`` to fit it on every row.
    """

    kind: str = "logistic_regression"
    params: dict = field(default_factory=lambda: {"class_weight": "balanced"})
    test_size: float = 0.2
    seed: int = 42
    max_features: int = 5000
    min_df: int = 5
    max_df: float = 0.8
    tfidf: bool = True
    ngrams: int = 2
    numeric: bool = False
    fit_scope: str = "train"


@dataclass
class Outcome:
    fitted: models.Fitted
    term_model: terms.TermModel
    predictions: DataFrame
    train: DataFrame
    test: DataFrame
    feature_names: list[str]
    labels: list[str]
    params: dict = field(default_factory=dict)

    def gradient_left(self, label: str) -> float:
        """How much of the loss's slope the solver has left over: 0 at the optimum, 1 without any fit."""
        end, start = models.gradient_norms(self.fitted, self.train, label, self.params)
        return end / start if start else 0.0

    def scores(self) -> DataFrame:
        return evaluate.scores(self.predictions, self.labels)

    def report(self) -> DataFrame:
        return evaluate.report(self.predictions, self.labels)

    def confusion_matrix(self) -> DataFrame:
        return evaluate.confusion_matrix(self.predictions, self.labels)

    def roc_auc(self) -> DataFrame:
        if not self.fitted.has_probability:
            return self.predictions.agg(F.lit(None).cast("double").alias("roc_auc"))
        return evaluate.roc_auc(self.predictions, {x: f"prob_{x}" for x in self.labels})

    def baseline_scores(self, label: str) -> DataFrame:
        guess = models.most_frequent(self.train, self.test, label).select(F.col(label).alias("actual"), "predicted")
        return evaluate.scores(guess, self.labels)


def text_pipeline(outcome: Outcome) -> PipelineModel:
    """Stages from raw text to prediction, for saving and for scoring new text."""
    from pyspark.ml.feature import VectorAssembler

    if outcome.feature_names != outcome.term_model.terms:
        raise ValueError("only text features can be saved as one pipeline")
    rename = VectorAssembler(inputCols=[outcome.term_model.output], outputCol="features")
    return PipelineModel([*outcome.term_model.stages.stages, rename, *outcome.fitted.stages.stages])


def score_texts(pipeline: PipelineModel, df: DataFrame, keep: list[str], labels: list[str]) -> DataFrame:
    """Class, confidence and the probability of every class for each text."""
    scored = pipeline.transform(df)
    rows = scored.select(*keep, "predicted", *[c.alias(n) for n, c in models.probability_columns(labels).items()])
    return rows.withColumn("confidence", F.greatest(*[F.col(f"prob_{x}") for x in labels]))


@dataclass
class Features:
    """A split with its feature vectors, written once, and the vectoriser that made them."""

    term_model: terms.TermModel
    names: list[str]
    train: DataFrame
    test: DataFrame


def features(df: DataFrame, row_id: str, text: str, label: str, s: Settings) -> Features:
    columns = df.select(row_id, text, label)
    if s.numeric:
        columns = columns.withColumns({
            "text_length": text_functions.char_length(text).cast("double"),
            "word_count": text_functions.word_count(text).cast("double"),
        })
    marked = measured(splits.stratified_split(columns, row_id, label, {"test": s.test_size}, "train", s.seed), "split")
    if s.numeric:  # from the written numbers, so that no text is counted a second time for means and deviations
        marked = terms.scale(marked, ["text_length", "word_count"])
    is_train = F.col("split") == "train"
    fit_rows = marked if s.fit_scope == "all" else marked.where(is_train)
    model = terms.fit_terms(fit_rows, text, s.max_features, s.min_df, s.max_df, None, s.ngrams, s.tfidf)
    inputs, names = [model.output], list(model.terms)
    if s.numeric:
        inputs += ["text_length_scaled", "word_count_scaled"]
        names += ["text_length", "word_count"]
    featured = measured(terms.assemble(model.transform(marked), inputs).select(row_id, label, "split", "features"), "features")
    return Features(model, names, featured.where(is_train), featured.where(~is_train))


def run(
    df: DataFrame, row_id: str, text: str, label: str, labels: list[str], settings: Settings | None = None,
    made: Features | None = None,
) -> Outcome:
    """Train and predict; ``made`` passes features that an earlier run with the same vectoriser settings has written."""
    s = settings or Settings()
    made = made or features(df, row_id, text, label, s)
    fitted = models.fit(made.train, s.kind, labels, label, {**s.params, "seed": s.seed})
    predictions = measured(models.predict(fitted, made.test, [row_id, F.col(label).alias("actual")]), "predictions")
    return Outcome(fitted, made.term_model, predictions, made.train, made.test, made.names, labels, s.params)


def pick_best(df: DataFrame, row_id: str, text: str, label: str, labels: list[str], candidates: dict[str, Settings]) -> tuple[str, Outcome, DataFrame]:
    """Run every candidate and keep the one with the best accuracy; also returns the comparison.

    Candidates that differ only in the classifier share one split and one vectoriser.
    """
    made: dict[str, Features] = {}
    outcomes = {}
    for name, s in candidates.items():
        shared = repr(replace(s, kind="", params={}))
        if shared not in made:
            made[shared] = features(df, row_id, text, label, s)
        outcomes[name] = run(df, row_id, text, label, labels, s, made[shared])
    table = evaluate.compare({name: o.scores() for name, o in outcomes.items()})
    best = evaluate.best_model(table).first()["model"]
    return best, outcomes[best], table


def best_length(
    df: DataFrame, row_id: str, text: str, label: str, labels: list[str], settings: Settings | None = None,
    lengths: tuple[int, ...] = (1, 2, 4, 8, 16, 32, 64, 128), validation: float = 0.15, patience: int = 2,
) -> tuple[Outcome, DataFrame]:
    """A logistic regression stopped at the number of iterations that does best on validation rows, and its history.

    A stratified part of the training rows is set aside. Fits of growing length are judged on it, and when ``patience`` of
    them in a row bring no better accuracy, longer ones are not tried. The solver takes the same steps whatever its
    limit, so a fit of some length is where a longer one was at that iteration. The history has one row per length:
    iterations, training loss, accuracy and loss on the validation rows, and whether it was chosen (the first of the
    best). The outcome is judged on the test rows. All lengths share one split and one vectoriser.
    """
    s = settings or Settings()
    if s.kind != "logistic_regression":
        raise ValueError("only the logistic regression is stopped by validation")
    made = features(df, row_id, text, label, s)
    marked = measured(splits.stratified_split(made.train, row_id, label, {"validation": validation}, "fit", s.seed, "_part"), "parts")
    fit_rows, held = (marked.where(F.col("_part") == part).drop("_part") for part in ("fit", "validation"))
    probabilities = {x: f"prob_{x}" for x in labels}
    history, best, since = [], None, 0
    for length in lengths:
        outcome = run(df, row_id, text, label, labels, replace(s, params={**s.params, "max_iter": length}), replace(made, train=fit_rows, test=held))
        losses = outcome.fitted.classifier.summary.objectiveHistory
        row = (length, len(losses) - 1, float(losses[-1]), outcome.scores().first()["accuracy"],
               evaluate.cross_entropy(outcome.predictions, probabilities).first()["loss"])
        history.append(row)
        since += 1
        if best is None or row[3] > best[0][3]:
            best, since = (row, outcome), 0
        if since >= patience or row[1] < length:  # a fit that ended by itself is as long as any
            break
    row, outcome = best
    predictions = measured(models.predict(outcome.fitted, made.test, [row_id, F.col(label).alias("actual")]), "predictions")
    table = df.sparkSession.createDataFrame(
        [(*h, h[0] == row[0]) for h in history],
        "length int, iterations int, loss double, validation_accuracy double, validation_loss double, chosen boolean")
    return replace(outcome, predictions=predictions, test=made.test), table
