"""Column functions over scores and engagement numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara import vocab
from opinara.functions.keywords import groups_found
from opinara.functions.text import _col


def sentiment_label(compound, threshold: float = vocab.LABEL_THRESHOLD) -> Column:
    c = _col(compound)
    return (
        F.when(c >= threshold, F.lit("positive"))
        .when(c <= -threshold, F.lit("negative"))
        .otherwise(F.lit("neutral"))
    )


def polarity_flags(compound, threshold: float = vocab.LABEL_THRESHOLD) -> dict[str, Column]:
    """0/1 flags; all three are 0 when the score is missing."""
    c = _col(compound)

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("int")

    return {
        "is_positive": flag(c >= threshold),
        "is_negative": flag(c <= -threshold),
        "is_neutral": flag((c > -threshold) & (c < threshold)),
    }


def magnitude(compound) -> Column:
    return F.abs(_col(compound))


def engagement(likes, replies) -> Column:
    return _col(likes) + _col(replies) * 2


def engagement_log(score) -> Column:
    """Natural log of one plus the score; NULL at or below minus one."""
    c = _col(score)
    return F.when(c > -1, F.log1p(c))


def subjectivity(text, compound, groups: list[list[str]] = vocab.SUBJECTIVE_GROUPS) -> Column:
    """0.125 for each phrase group found plus half the absolute polarity, at most one."""
    return F.least(groups_found(text, groups) * 0.125 + F.abs(_col(compound)) * 0.5, F.lit(1.0))


def verdict(mean, threshold: float = vocab.LABEL_THRESHOLD) -> Column:
    c = _col(mean)
    return (
        F.when(c > threshold, F.lit("POSITIVE"))
        .when(c < -threshold, F.lit("NEGATIVE"))
        .otherwise(F.lit("NEUTRAL"))
    )


def share(part, whole) -> Column:
    """Percentage, NULL when the whole is zero."""
    return F.try_divide(_col(part) * 100.0, _col(whole))
