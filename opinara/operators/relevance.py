"""Row filters: relevance, dates, engagement, removed bodies, empty texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara import vocab
from opinara.functions import keywords, scores, text


def words_between(c, low: int, high: int) -> Column:
    return text.once(text.word_count(c), lambda n: n.between(low, high))


def topical(c, societal: list[str] = vocab.SOCIETAL_KEYWORDS_WIDE, ai: list[str] = vocab.AI_KEYWORDS,
            opinion: list[str] = vocab.OPINION_KEYWORDS) -> Column:
    """AI keyword together with an opinion or a societal one, by substring."""
    return keywords.contains_any(c, ai) & (keywords.contains_any(c, opinion) | keywords.contains_any(c, societal))


def post_prefilter(c, **lists) -> Column:
    """The part of the post filter that needs no polarity score."""
    return words_between(c, vocab.MIN_WORDS, vocab.MAX_WORDS_POST) & topical(c, **lists)


def relevant_post(c, compound, **lists) -> Column:
    return post_prefilter(c, **lists) & (scores.subjectivity(c, compound) >= vocab.MIN_SUBJECTIVITY_POST)


def relevant_comment_a(c, **lists) -> Column:
    return words_between(c, vocab.MIN_WORDS, vocab.MAX_WORDS_COMMENT) & topical(c, **lists)


def comment_b_prefilter(cleaned, ai: tuple[list[str], list[str]] = (vocab.AI_WHOLE_WORDS, vocab.AI_PHRASES), opinion: list[str] = vocab.OPINION_KEYWORDS,
                        societal: list[str] = vocab.SOCIETAL_KEYWORDS, min_sentences: int = 1) -> Column:
    """The part of the platform B filter that needs no polarity score; expects cleaned text."""
    def keep(t: Column) -> Column:
        return (
            words_between(t, vocab.MIN_WORDS, vocab.MAX_WORDS_COMMENT)
            & keywords.mentions_ai(t, *ai)
            & (keywords.contains_any_phrase(t, opinion) | keywords.contains_any_phrase(t, societal))
            & (text.valid_sentences(t) >= min_sentences)
        )

    return text.once(F.col(cleaned) if isinstance(cleaned, str) else cleaned, keep)


def relevant_comment_b(cleaned, compound, **lists) -> Column:
    return comment_b_prefilter(cleaned, **lists) & (
        scores.subjectivity(cleaned, compound) >= vocab.MIN_SUBJECTIVITY_COMMENT
    )


def present_body(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (c != "") & ~c.isin(vocab.REMOVED_BODIES)


def in_date_range(ts, start: str = vocab.START_DATE, end: str = vocab.END_DATE_A) -> Column:
    """Inclusive range over literals, which reaches the Parquet scan."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return c.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))


def engaged_post(is_self, n_comments, minimum: int = vocab.MIN_POST_COMMENTS) -> Column:
    return F.col(is_self) & (F.col(n_comments) >= minimum)


def engaged_video(n_comments, minimum: int = vocab.MIN_VIDEO_COMMENTS) -> Column:
    return F.col(n_comments) >= minimum


def drop_null_critical(df: DataFrame, critical: tuple[str, ...] = ("cleaned_text", "sentiment")) -> DataFrame:
    present = [c for c in critical if c in df.columns]
    return df.dropna(subset=present) if present else df


def drop_empty_text(df: DataFrame, column: str = "text_clean") -> DataFrame:
    return df.where(F.length(column) > 0)


def removed_report(df: DataFrame, column: str = "text_clean") -> DataFrame:
    """Rows before, rows removed for empty text, rows left."""
    kept = F.count_if(F.length(column) > 0)
    return df.agg(F.count("*").alias("n_before"), (F.count("*") - kept).alias("n_removed"), kept.alias("n_after"))
