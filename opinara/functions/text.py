"""Column functions for text: cleaning steps, cleaning profiles, counts.

Whitespace, word characters and digits follow Unicode. Every function evaluates its input once: filters share
no subexpressions, so a cleaned text used by several conditions would be cleaned again for each of them.
"""

from __future__ import annotations

import unicodedata
from functools import cache, reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara import vocab

# In (?U) mode \s is Unicode white space; the separators U+001C to U+001F count as white space too.
_U = "(?U)"
SPACE = r"[\s\x1C-\x1F]"
NOT_SPACE = r"[^\s\x1C-\x1F]"
WORD_CHARS = r"\p{L}\p{N}_"

URL = rf"{_U}(?:http|www\.){NOT_SPACE}+"
URL_LOOSE = rf"{_U}(?:http|www){NOT_SPACE}+"
# Matches a whole run of non-space characters with an inner `@`. The look-behind pins it to the start of a
# run and the possessive part never backtracks, so a long unbroken run costs one pass.
EMAIL = rf"{_U}(?<!{NOT_SPACE}){NOT_SPACE}[^@\s\x1C-\x1F]*+@{NOT_SPACE}+"
MENTION = rf"@[{WORD_CHARS}]+"
HASHTAG = rf"#([{WORD_CHARS}]+)"
SPECIAL = rf"""{_U}[^{WORD_CHARS}\s\x1C-\x1F.,!?'"-]"""


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated a single time, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def remove_urls(c, loose: bool = False) -> Column:
    return F.regexp_replace(_col(c), URL_LOOSE if loose else URL, "")


def remove_emails(c) -> Column:
    return F.regexp_replace(_col(c), EMAIL, "")


def remove_mentions(c) -> Column:
    return F.regexp_replace(_col(c), MENTION, "")


def unwrap_hashtags(c) -> Column:
    return F.regexp_replace(_col(c), HASHTAG, "$1")


def strip_symbols(c, symbols: str = "@#") -> Column:
    return F.translate(_col(c), symbols, "")


def collapse_whitespace(c) -> Column:
    return F.trim(F.regexp_replace(_col(c), f"{_U}{SPACE}+", " "))


def remove_punctuation(c, keep_sentence_end: bool = False) -> Column:
    drop = vocab.PUNCTUATION
    if keep_sentence_end:
        drop = "".join(ch for ch in drop if ch not in ".!?")
    return F.translate(_col(c), drop, "")


def remove_digits(c) -> Column:
    return F.regexp_replace(_col(c), r"\p{Nd}+", "")


def blank_special(c) -> Column:
    return F.regexp_replace(_col(c), SPECIAL, " ")


def _letters(even: Column) -> Column:
    return F.length(F.replace(even, F.lit(" "), F.lit("")))


def word_count(c, collapsed: bool = False) -> Column:
    """Words between white space. ``collapsed`` says that white space is already even and trimmed."""
    def count(even: Column) -> Column:
        return F.length(even) - _letters(even) + F.when(F.length(even) > 0, 1).otherwise(0)

    return F.coalesce(once(_col(c) if collapsed else collapse_whitespace(c), count), F.lit(0))


def char_length(c) -> Column:
    return F.length(_col(c))


def average_word_length(c, collapsed: bool = False) -> Column:
    """Mean length of the words; zero without words."""
    def mean(even: Column) -> Column:
        return once(_letters(even), lambda letters: letters / (F.length(even) - letters + 1))

    return F.coalesce(once(_col(c) if collapsed else collapse_whitespace(c), mean), F.lit(0.0))


def count_char(c, char: str) -> Column:
    c = _col(c)
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def has_char(c, char: str) -> Column:
    return F.contains(_col(c), F.lit(char))


def sentence_count(c) -> Column:
    return count_char(c, ".") + count_char(c, "!") + count_char(c, "?")


def sentences(c) -> Column:
    return F.split(_col(c), r"[.!?]+")


def valid_sentences(c, longer_than: int = 5) -> Column:
    """Number of sentences with more than ``longer_than`` characters once stripped."""
    return F.size(F.filter(sentences(c), lambda s: F.length(collapse_ends(s)) > longer_than))


def collapse_ends(c) -> Column:
    return F.regexp_replace(_col(c), f"{_U}^{SPACE}+|{SPACE}+$", "")


def truncate(c, n: int, tail: str = "...") -> Column:
    def short(t: Column) -> Column:
        return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(tail))).otherwise(t)

    return once(_col(c), short)


def tokens(c) -> Column:
    """Words of a text as an array, without empty entries."""
    return F.array_remove(F.split(collapse_whitespace(c), " "), "")


def drop_words(words: Column, stop_words: list[str]) -> Column:
    return F.filter(words, lambda w: ~F.lower(w).isin(stop_words))


def split_contractions(c) -> Column:
    """Cut the listed words in two: a space goes after the first part of a whole word."""
    pairs = [pair.split("|") for pair in vocab.SPLIT_WORDS]
    cuts = "|".join(rf"(?<=(?<![{WORD_CHARS}]){left})(?={right}(?![{WORD_CHARS}]))" for left, right in pairs)
    initials = "".join(sorted({left[0] for left, _ in pairs}))
    return F.regexp_replace(_col(c), rf"[{initials}][a-z]{{2}}(?:{cuts})", "$0 ")


def remove_stop_words(c, stop_words: list[str], lemma=None) -> Column:
    """The words that are no stop words, by a space; ``lemma`` gives the form of each that stands in the result."""
    words = drop_words(tokens(split_contractions(c)), stop_words)
    return F.array_join(F.transform(words, lambda w: lemma(w)) if lemma else words, " ")


# --- cleaning profiles: a null text becomes an empty one ----------------------------------------------


def _marked(c: Column, markers: tuple[str, ...], cleaned: Column) -> Column:
    """``cleaned`` where the raw text has one of the markers that every pattern needs, else the text itself."""
    return F.when(reduce(or_, [F.contains(c, F.lit(m)) for m in markers]), cleaned).otherwise(c)


def _present(c) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def _without_social(c) -> Column:
    text = _present(c)
    cleaned = unwrap_hashtags(remove_mentions(remove_emails(remove_urls(text))))
    return F.lower(_marked(text, ("http", "www.", "@", "#"), cleaned))


def clean_basic(c) -> Column:
    return collapse_whitespace(_without_social(c))


def clean_standard(c) -> Column:
    return collapse_whitespace(remove_digits(remove_punctuation(clean_basic(c))))


def clean_aggressive(c, stop_words: list[str], lemma=None) -> Column:
    """Standard cleaning without stop words; ``operators.lemmas.dictionary`` makes a ``lemma`` of a table."""
    return remove_stop_words(clean_standard(c), stop_words, lemma)


def clean_for_tfidf(c, stop_words: list[str], lemma=None) -> Column:
    return remove_stop_words(remove_digits(remove_punctuation(_without_social(c))), stop_words, lemma)


def clean_minimal(c) -> Column:
    text = _present(c)
    return collapse_whitespace(_marked(text, ("http", "www.", "@", "#"), strip_symbols(remove_emails(remove_urls(text)))))


def clean_platform_b(c) -> Column:
    text = _present(c)
    return collapse_whitespace(blank_special(_marked(text, ("http", "www"), remove_urls(text, loose=True))))


def with_profiles(df: DataFrame, column: str, stop_words: list[str], lemma=None) -> DataFrame:
    """All cleaning profiles of a column side by side; steps that profiles share are done once."""
    staged = df.withColumn("_social", _without_social(column)).withColumn("basic", collapse_whitespace("_social"))
    staged = staged.withColumn("standard", collapse_whitespace(remove_digits(remove_punctuation("basic"))))
    return staged.withColumns({
        "aggressive": remove_stop_words("standard", stop_words, lemma),
        "tfidf": remove_stop_words(remove_digits(remove_punctuation("_social")), stop_words, lemma),
        "minimal": clean_minimal(column), "platform_b": clean_platform_b(column),
    }).drop("_social")


PROFILES = ("basic", "standard", "aggressive", "tfidf", "minimal", "platform_b")


def strip_accents(c) -> Column:
    """Compatibility decomposition without combining marks (no built-in function does this).

    The function is local, so workers receive it by value and need not import this package.
    """
    def plain(value):
        import unicodedata

        if value is None or value.isascii():
            return value
        return "".join(ch for ch in unicodedata.normalize("NFKD", value) if not unicodedata.combining(ch))

    def convert(values: pd.Series) -> pd.Series:
        return values.map(plain)

    return F.pandas_udf(convert, T.StringType())(_col(c))


@cache
def _plain_letters() -> tuple[str, str]:
    """Characters of the basic plane that decompose to one letter or digit, with it; combining marks follow, without."""
    mapped, marks = {}, []
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x10000)]:
        ch = chr(code)
        if unicodedata.combining(ch):
            marks.append(ch)
            continue
        rest = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if rest != ch and len(rest) == 1 and rest.isalnum():
            mapped[ch] = rest
    return "".join(mapped) + "".join(marks), "".join(mapped.values())


def plain_letters(c) -> Column:
    """Letters without accents, by built-in functions. ASCII texts are only tested.

    The same as ``strip_accents`` but for characters that decompose to several letters, such as ligatures and Hangul
    syllables, which stay.
    """
    return F.when(_col(c).rlike(r"[^\x00-\x7F]"), F.translate(_col(c), *_plain_letters())).otherwise(_col(c))


def plain_letters_sql(expression: str) -> str:
    """The same as SQL text."""
    found, plain = _plain_letters()
    return f"CASE WHEN {expression} RLIKE '[^\\\\x00-\\\\x7F]' THEN translate({expression}, '{found}', '{plain}') ELSE {expression} END"


def strip_accents_latin1(c) -> Column:
    """Built-in fast path for text known to use the Latin-1 letters only."""
    accented = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
    plain = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
    return F.translate(_col(c), accented, plain)
