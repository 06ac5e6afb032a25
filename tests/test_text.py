import re
import string
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opinara import vocab
from opinara.functions import keywords, text
from opinara.operators import lemmas, relevance

SAMPLES = [
    None, "", "   ", "See https://x.y a@b.c @bob #AI now", "##tag", "naïve café 😀", "one two\tthree\x1cfour",
    "wait... what?! www.site.org/x and http", "@@a @b c@ d@e.f", "Cannot stop; gonna win 123 ٤٥", "a\n\n b  ", "x" * 300 + "@" + "y" * 300,
]


def clean_basic(t):
    """The cleaning rules written with Python's own string functions."""
    if t is None:
        return ""
    t = re.sub(r"http\S+|www\.\S+|https\S+", "", t)
    t = re.sub(r"\S+@\S+", "", t)
    t = re.sub(r"@\w+", "", t)
    t = re.sub(r"#\w+", lambda m: m.group(0)[1:], t)
    return " ".join(t.lower().split())


def clean_standard(t):
    t = clean_basic(t).translate(str.maketrans("", "", string.punctuation))
    return " ".join(re.sub(r"\d+", "", t).split())


def clean_platform_b(t):
    t = re.sub(r"http\S+|www\S+|https\S+", "", t or "")
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s.,!?'\"-]", " ", t)).strip()


def test_profiles_follow_python(evaluate_text):
    assert evaluate_text(text.clean_basic, SAMPLES) == [clean_basic(t) for t in SAMPLES]
    assert evaluate_text(text.clean_standard, SAMPLES) == [clean_standard(t) for t in SAMPLES]
    assert evaluate_text(text.clean_platform_b, SAMPLES) == [clean_platform_b(t) for t in SAMPLES]


def test_golden_rows(evaluate_text):
    assert evaluate_text(text.clean_basic, ["See https://x.y a@b.c @bob #AI now", "##tag", None]) == ["see ai now", "#tag", ""]
    assert evaluate_text(text.clean_minimal, ["Hi @bob, see #AI  now a@b.c"]) == ["Hi bob, see AI now"]
    assert evaluate_text(text.clean_platform_b, ["naïve café 😀"]) == ["naïve café"]
    assert evaluate_text(text.char_length, ["naïve café 😀"]) == [12]


def test_counts(evaluate_text):
    assert evaluate_text(text.word_count, SAMPLES) == [len((t or "").split()) for t in SAMPLES]
    means = [sum(map(len, t.split())) / len(t.split()) if t and t.split() else 0 for t in SAMPLES]
    assert evaluate_text(text.average_word_length, SAMPLES) == pytest.approx(means)
    assert evaluate_text(lambda c: text.count_char(c, "!"), ["a!b!!", ""]) == [3, 0]
    assert evaluate_text(text.sentence_count, ["a. b! c?", "none"]) == [3, 0]
    assert evaluate_text(text.valid_sentences, ["short. long enough one!  x ?"]) == [1]
    assert evaluate_text(lambda c: text.truncate(c, 3), ["abcd", "abc", None]) == ["abc...", "abc", None]


def test_stop_words_and_contractions(evaluate_text):
    drop = lambda c: text.clean_for_tfidf(c, vocab.STOP_WORDS)
    assert evaluate_text(drop, ["I cannot believe the results, gonna test 42!"]) == ["believe results gon na test"]
    assert evaluate_text(text.split_contractions, ["cannot scannot cannots gimme"]) == ["can not scannot cannots gim me"]


def test_accents(evaluate_text):
    values = ["naïve café ﬁ", "plain", None, "Ångström"]
    expected = [None if v is None else "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)) for v in values]
    assert evaluate_text(text.strip_accents, values) == expected
    assert evaluate_text(text.strip_accents_latin1, ["naïve café"]) == ["naive cafe"]


def test_keyword_rules(evaluate_text):
    assert evaluate_text(keywords.mentions_ai, ["naïai x", "said", "AI!", "deep learning", None]) == [False, False, True, True, False]
    assert evaluate_text(lambda c: keywords.contains_any(c, vocab.AI_KEYWORDS), ["naïai x", "said", "AI!", "none", None]) == [True, True, True, False, False]
    assert evaluate_text(lambda c: keywords.contains_any_phrase(c, ["deep learning"]), ["learning is deep", "learning"]) == [True, False]
    assert evaluate_text(lambda c: keywords.contains_any_phrase(c, ["Deep learning", "GPT"]), ["deep learning", "gpt"]) == [False, True]
    assert evaluate_text(keywords.distinct_hits, ["ChatGPT and gpt and AI", ""]) == [3, 0]
    assert evaluate_text(lambda c: keywords.matches_search([c, F.lit("future")]), ["GPT news", "news"]) == [True, False]


def test_word_bounds(evaluate_text):
    body = lambda n: " ".join(["ai", "think"] + ["w"] * (n - 2))
    keep = lambda c: relevance.relevant_comment_a(c)
    assert evaluate_text(keep, [body(9), body(10), body(300), body(301)]) == [False, True, True, False]
    in_b = lambda c: relevance.comment_b_prefilter(c)
    assert evaluate_text(in_b, [body(9), body(10), body(300), body(301)]) == [False, True, True, False]
    assert evaluate_text(relevance.present_body, ["x", "", "[deleted]", "[removed]", None]) == [True, False, False, False, False]


def test_lemmas_keep_order_and_unknown_words(spark):
    rows = spark.createDataFrame([(1, "cats are  running"), (2, ""), (3, "cats cats dog"), (1, "dog"), (1, "dog"), (4, None)], "id int, t string")
    small = spark.createDataFrame([("cats", "cat"), ("running", "run"), ("cats", "cot"), (None, "x"), ("dog", None), ('q"\\é', "y")], "form string, lemma string")
    large = small.unionByName(spark.range(200_000).selectExpr("concat('form', id) AS form", "concat('lemma', id) AS lemma"))
    for table in (small, large, small.limit(0)):
        done = lemmas.lemmatise(rows, "t", table, "l")
        assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()
        out = sorted((r["id"], r["l"]) for r in done.collect())
        empty = table.isEmpty()
        assert out == [(1, "cats are running" if empty else "cat are run"), (1, "dog"), (1, "dog"), (2, ""), (3, "cats cats dog" if empty else "cat cat dog"), (4, "")]
    forms = spark.createDataFrame([('form77 form199999 form200000 q"\\é',)], "t string")
    assert lemmas.lemmatise(forms, "t", large).first()["lemmatised"] == "lemma77 lemma199999 form200000 y"


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=("Cs", "Cn", "Lm", "Lt")), max_size=40), min_size=200, max_size=200))
def test_whitespace_and_counts_on_random_text(evaluate_text, values):
    values = [v.replace("\x00", "") for v in values]
    assert evaluate_text(text.collapse_whitespace, values) == [" ".join(v.split()) for v in values]
    assert evaluate_text(text.word_count, values) == [len(v.split()) for v in values]
    assert evaluate_text(text.remove_punctuation, values) == [v.translate(str.maketrans("", "", string.punctuation)) for v in values]


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="abc .,!? xyz\n", max_size=60), min_size=200, max_size=200))
def test_basic_cleaning_leaves_plain_text(evaluate_text, values):
    assert evaluate_text(text.clean_basic, values) == [" ".join(v.split()) for v in values]
