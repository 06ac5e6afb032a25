"""Column predicates over keyword lists."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara import vocab
from opinara.functions.text import WORD_CHARS, _col, once


def _lowered(c, body) -> Column:
    """A predicate over the lower-cased text, which is lower-cased once; false for a missing text."""
    return F.coalesce(once(F.lower(_col(c)), body), F.lit(False))


def _has(text: Column, keywords: list[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(k.lower())) for k in keywords])


def _has_word(text: Column, words: list[str]) -> Column:
    """The pattern only runs on texts that contain an entry as a substring."""
    pattern = rf"(^|[^{WORD_CHARS}])({'|'.join(words)})([^{WORD_CHARS}]|$)"
    return _has(text, words) & text.rlike(pattern)


def _has_phrase(text: Column, keywords: list[str]) -> Column:
    def one(keyword: str) -> Column:
        if " " in keyword:
            return reduce(and_, [F.contains(text, F.lit(w)) for w in keyword.split()])
        return F.contains(text, F.lit(keyword.lower()))

    return reduce(or_, [one(k) for k in keywords])


def contains_any(c, keywords: list[str]) -> Column:
    """Some keyword occurs as a substring, whatever the case."""
    return _lowered(c, lambda text: _has(text, keywords))


def contains_any_phrase(c, keywords: list[str]) -> Column:
    """As ``contains_any``, but a keyword of several words matches when each word occurs somewhere.

    The words of such a keyword keep their case while the text is lower-cased.
    """
    return _lowered(c, lambda text: _has_phrase(text, keywords))


def contains_word(c, words: list[str]) -> Column:
    """Some entry occurs between word boundaries, whatever the case."""
    return _lowered(c, lambda text: _has_word(text, words))


def groups_found(c, groups: list[list[str]]) -> Column:
    """In how many of the groups some entry occurs between word boundaries."""
    def count(text: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.when(_has_word(text, g), 1).otherwise(0) for g in groups])

    return F.coalesce(once(F.lower(_col(c)), count), F.lit(0))


def mentions_ai(c, words: list[str] = vocab.AI_WHOLE_WORDS, phrases: list[str] = vocab.AI_PHRASES) -> Column:
    """Whole-word acronyms or in-order phrases."""
    return _lowered(c, lambda text: _has(text, phrases) | _has_word(text, words))


def distinct_hits(c, keywords: list[str] = vocab.FEATURE_AI_KEYWORDS) -> Column:
    """How many of the keywords occur at least once."""
    def count(text: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.contains(text, F.lit(k.lower())).cast("int") for k in keywords])

    return F.coalesce(once(F.lower(_col(c)), count), F.lit(0))


def matches_search(columns: list, groups: list[list[str]] = vocab.SEARCH_GROUPS) -> Column:
    """Every group has some term in the title or the body."""
    text = F.concat_ws(" ", *[_col(c) for c in columns])
    return _lowered(text, lambda t: reduce(and_, [_has(t, g) for g in groups]))


def content_flags(c, ai: Column, societal: list[str], opinion: list[str] = vocab.OPINION_KEYWORDS) -> dict[str, Column]:
    return {
        "contains_ai": ai,
        "contains_opinion": contains_any(c, opinion),
        "contains_societal": contains_any(c, societal),
    }
