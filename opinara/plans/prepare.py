"""Harmonise, union, dedupe, clean, engineer: two raw platform tables to the final table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from opinara import vocab
from opinara.functions import calendar, scores, text
from opinara.operators import joins, lemmas, relevance, shaping


def clean_columns(df: DataFrame, source: str = "text", stop_words: list[str] | None = None, lemma_table: DataFrame | None = None) -> DataFrame:
    """The three text columns in one projection."""
    stop_words = vocab.STOP_WORDS if stop_words is None else stop_words
    return df.withColumns({
        "text_tfidf": text.clean_for_tfidf(source, stop_words, lemmas.dictionary(lemma_table) if lemma_table is not None else None),
        "text_bert": text.clean_minimal(source),
        "text_clean": text.clean_basic(source),
    })


def engineer(df: DataFrame) -> DataFrame:
    """Time, text, engagement, polarity and community columns.

    Community sizes count every row, also those whose cleaned text turns out empty.
    """
    score = scores.engagement("likes", "replies")
    df = df.withColumns({
        **calendar.parts("created_at"),
        "word_count": text.word_count("text_clean", collapsed=True),
        "exclamation_count": text.count_char("text", "!"),
        "question_count": text.count_char("text", "?"),
        "period_count": text.count_char("text", "."),
        "engagement_score": score,
        "engagement_log": scores.engagement_log(score),
        **scores.polarity_flags("sentiment_compound"),
        "sentiment_magnitude": scores.magnitude("sentiment_compound"),
    })
    return joins.with_group_size(df, "platform_community")


def merge(raw_a: DataFrame, raw_b: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return shaping.union_all(
        shaping.harmonise(raw_a, vocab.PLATFORM_A, keep), shaping.harmonise(raw_b, vocab.PLATFORM_B, keep)
    )


def prepare(raw_a: DataFrame, raw_b: DataFrame, order: str, stop_words: list[str] | None = None,
            lemma_table: DataFrame | None = None) -> DataFrame:
    """The final table. ``order`` is a column of both inputs that numbers their rows."""
    merged = shaping.keep_first(merge(raw_a, raw_b, (order,)), ["text"], ["source_rank", order])
    featured = engineer(clean_columns(merged, "text", stop_words, lemma_table)).drop("source_rank", order)
    return shaping.finalise_types(relevance.drop_empty_text(featured))
