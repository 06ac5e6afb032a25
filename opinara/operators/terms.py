"""Term features: tokens, n-grams, vocabulary, counts and TF-IDF."""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer, StopWordsRemover, VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.text import WORD_CHARS, plain_letters, plain_letters_sql
from opinara.operators.counts import counted, counted_among, frequent
from opinara.operators.sizing import measured
from opinara.operators.words import with_pairs

MAX_VOCABULARY = 1_000_000


def words(c, stop_words: list[str] = ()) -> Column:
    """Runs of two or more word characters, lower case, without accents and stop words."""
    found = F.regexp_extract_all(plain_letters(F.lower(c)), F.lit(rf"([{WORD_CHARS}]{{2,}})"), F.lit(1))
    return F.filter(found, lambda w: ~w.isin(list(stop_words))) if stop_words else found


def terms(c, stop_words: list[str] = (), ngrams: int = 2) -> Column:
    """Words, with neighbouring pairs when ``ngrams`` is 2; pairs are formed after stop words are gone."""
    single = words(c, stop_words)
    return with_pairs(single) if ngrams == 2 else single


def term_statistics(df: DataFrame, text: str, stop_words: list[str] = (), words: bool = True, pairs: bool = False, among: list[str] | None = None) -> DataFrame:
    """Total count and document count of every word, every pair, or every pair of the words ``among``."""
    plain, term = plain_letters(F.lower(text)), F.concat_ws(" ", "first", "second").alias("term")
    if among is not None:
        return counted_among(df, plain, among, None, stop_words).select(term, "n", "n_docs")
    return counted(df, plain, None, stop_words, words=words, pairs=pairs).groupBy(term).agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def vocabulary(
    df: DataFrame, text: str, max_features: int, min_df: int = 1, max_df: float = 1.0,
    stop_words: list[str] = (), ngrams: int = 2,
) -> DataFrame:
    """The most frequent terms within the document bounds, ties by term, indexed in alphabetical order.

    Words are counted first. A pair occurs no oftener than its words, so pairs are counted of words alone that occur as
    often as the last word that would be kept without any pair.
    """
    if max_features > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary of more than {MAX_VOCABULARY} terms does not fit the driver")
    from pyspark.sql import Window as W

    eligible = F.col("n_docs") >= min_df
    if max_df < 1.0:
        eligible = eligible & (F.col("n_docs") <= F.lit(max_df) * F.lit(df.count()))
    stats = term_statistics(df, text, stop_words)
    if ngrams == 2:
        stats = measured(stats, "statistics")
        among = frequent(stats.select(F.lit(None).cast("string").alias("_by"), "term", "n", eligible.alias("eligible")), max_features)
        stats = stats.unionByName(term_statistics(df, text, stop_words, words=False, pairs=True, among=among))
    kept = stats.where(eligible).orderBy(F.desc("n"), "term").limit(max_features)
    return kept.select((F.row_number().over(W.orderBy("term")) - 1).alias("index"), "term", "n", "n_docs")


def default_stop_words() -> list[str]:
    """The English list that Spark ML gives its vectorisers; it is not the list that the cleaning profiles use."""
    return StopWordsRemover.loadDefaultStopWords("english")


def idf(n_docs: int, document_count: int) -> float:
    return math.log((1 + n_docs) / (1 + document_count)) + 1


class TermModel:
    """A fitted vectoriser: its vocabulary and the map-only Spark ML stages that apply it.

    Only the vocabulary, at most ``max_features`` rows, reaches the driver.
    """

    def __init__(self, vocabulary_rows: list, n_docs: int, stages: PipelineModel, output: str):
        self.terms = [r["term"] for r in vocabulary_rows]
        self.n_docs = n_docs
        self.stages = stages
        self.output = output

    def transform(self, df: DataFrame) -> DataFrame:
        return self.stages.transform(df)


def _stages(text: str, vocab_rows: list, stop_words, ngrams: int, weights: list[float] | None, output: str) -> PipelineModel:
    pattern = rf"([{WORD_CHARS}]{{2,}})"

    def quoted(value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    stop = ", ".join(map(quoted, stop_words))
    found = f"regexp_extract_all({plain_letters_sql(f'lower(`{text}`)')}, {quoted(pattern)}, 1)"
    kept = f"filter({found}, w -> w not in ({stop}))" if stop else found
    stages = [SQLTransformer(statement=f"select *, coalesce({kept}, array()) as _words from __THIS__")]
    known = [r["term"] for r in vocab_rows]
    wanted = [{x.split(" ")[side] for x in known if " " in x} for side in (0, 1)]
    joined = "_words"
    if ngrams == 2 and wanted[0]:
        # Only pairs of which each word has its place in some pair of the vocabulary are written out.
        first, second = (", ".join(map(quoted, sorted(side))) for side in wanted)
        pairs = ("zip_with(slice(_words, 1, greatest(size(_words) - 1, 0)), slice(_words, 2, greatest(size(_words) - 1, 0)), "
                 f"(a, b) -> case when a in ({first}) then case when b in ({second}) then concat_ws(' ', a, b) end end)")
        joined = f"concat(_words, filter({pairs}, p -> p is not null))"
    stages.append(SQLTransformer(statement=f"select *, {joined} as _terms from __THIS__"))
    counted = output if weights is None else "_counts"
    counter = CountVectorizerModel.from_vocabulary(known, inputCol="_terms", outputCol=counted)
    stages.append(counter)
    drop = ["_words", "_terms"]
    if weights is not None:
        stages.append(ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="_counts", outputCol="_weighted"))
        stages.append(Normalizer(p=2.0, inputCol="_weighted", outputCol=output))
        drop += ["_counts", "_weighted"]
    stages.append(SQLTransformer(statement=f"select * except ({', '.join(drop)}) from __THIS__"))
    return PipelineModel(stages)


def fit_terms(
    df: DataFrame, text: str, max_features: int = 5000, min_df: int = 5, max_df: float = 0.8,
    stop_words: list[str] | None = None, ngrams: int = 2, tfidf: bool = True, output: str = "term_features",
) -> TermModel:
    """Fit a count or TF-IDF vectoriser on a table; the stop words default to those for vectorisers."""
    stop_words = default_stop_words() if stop_words is None else stop_words
    vocab_rows = vocabulary(df, text, max_features, min_df, max_df, stop_words, ngrams).orderBy("index").collect()
    if not vocab_rows:
        raise ValueError("no terms left in the vocabulary")
    n_docs = df.count()
    weights = [idf(n_docs, r["n_docs"]) for r in vocab_rows] if tfidf else None
    return TermModel(vocab_rows, n_docs, _stages(text, vocab_rows, stop_words, ngrams, weights, output), output)


def sparse_entries(df: DataFrame, row_id: str, vector: str) -> DataFrame:
    """Non-zero entries of a sparse vector column as ``(row, index, weight)`` rows, without a shuffle."""
    v = F.unwrap_udt(vector)
    return df.select(row_id, F.inline(F.arrays_zip(v["indices"].alias("index"), v["values"].alias("weight"))))


def tfidf_table(
    df: DataFrame, row_id: str, text: str, max_features: int = 5000, min_df: int = 5, max_df: float = 0.8,
    stop_words: list[str] | None = None, ngrams: int = 2, tfidf: bool = True,
) -> DataFrame:
    """The document-term matrix as ``(row, term, weight)``."""
    model = fit_terms(df, text, max_features, min_df, max_df, stop_words, ngrams, tfidf)
    names = measured(df.sparkSession.createDataFrame(list(enumerate(model.terms)), "index int, term string"), "names")
    entries = sparse_entries(model.transform(df.select(row_id, text)), row_id, model.output)
    return entries.join(names, "index").select(row_id, "term", "weight")


def scale(df: DataFrame, columns: list[str], suffix: str = "_scaled") -> DataFrame:
    """Zero mean and unit population deviation; a constant column is only centred."""
    stats = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))])

    def scaled(c: str) -> Column:
        std = stats.select(f"std_{c}").scalar()
        centred = F.col(c) - stats.select(f"mean_{c}").scalar()
        return centred / F.when(std == 0, 1.0).otherwise(std)

    return df.select("*", *[scaled(c).alias(c + suffix) for c in columns])


def assemble(df: DataFrame, columns: list[str], output: str = "features") -> DataFrame:
    """Vectors and numbers side by side in one vector."""
    return VectorAssembler(inputCols=columns, outputCol=output, handleInvalid="keep").transform(df)
