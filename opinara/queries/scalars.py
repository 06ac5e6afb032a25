"""Queries for the scalar text, time and number functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara import vocab
from opinara.functions import calendar, keywords, scores, text
from opinara.operators import lemmas, models
from opinara.queries import tables as t
from opinara.queries.registry import dates_as_text, query, rounded


def _select(name: str, sql: dict[str, str], build, digits: int | None = None):
    """A row-level query over ``documents``: SQL expressions and a function giving the same columns."""
    listed = ", ".join(f"{e} AS {k}" for k, e in sql.items())

    @query(name, f"SELECT doc_id, {listed} FROM documents")
    def run(spark, sf):
        df = t.table(spark, sf, "documents").select("doc_id", *[c.alias(k) for k, c in build(F.col("text")).items()])
        return rounded(df, digits) if digits is not None else df


_select("i01_remove_urls", {
    "strict": t.s_replace("text", rf"(http|www\.){t.NOT_SPACE}+"), "loose": t.s_replace("text", f"(http|www){t.NOT_SPACE}+"),
}, lambda c: {"strict": text.remove_urls(c), "loose": text.remove_urls(c, loose=True)})

_select("i02_remove_emails_and_mentions", {
    "emails": t.s_replace("text", f"{t.NOT_SPACE}+@{t.NOT_SPACE}+"),
    "mentions": t.s_replace(t.s_replace("text", f"{t.NOT_SPACE}+@{t.NOT_SPACE}+"), f"@[{t.W}]+"),
}, lambda c: {"emails": text.remove_emails(c), "mentions": text.remove_mentions(text.remove_emails(c))})

_select("i03_unwrap_hashtags", {"out": t.s_replace("text", f"#([{t.W}]+)", r"\1")}, lambda c: {"out": text.unwrap_hashtags(c)})
_select("i04_strip_symbols", {"out": "translate(text, '@#', '')"}, lambda c: {"out": text.strip_symbols(c)})
_select("i05_collapse_and_lower", {"out": f"lower({t.s_collapse('text')})"}, lambda c: {"out": F.lower(text.collapse_whitespace(c))})
_select("i06_remove_punctuation", {
    "every": t.s_no_punct("text"),
    "kept_ends": f"translate(text, {t.q(''.join(ch for ch in vocab.PUNCTUATION if ch not in '.!?'))}, '')",
}, lambda c: {"every": text.remove_punctuation(c), "kept_ends": text.remove_punctuation(c, keep_sentence_end=True)})
_select("i07_digits_and_special", {
    "digits": t.s_no_digits("text"),
    "special": t.s_replace("text", rf"""[^{t.W}\s\p{{Z}}\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}.,!?'"-]""", " "),
}, lambda c: {"digits": text.remove_digits(c), "special": text.blank_special(c)})
_select("i08_word_count", {"n": f"CAST({t.s_words('text')} AS INTEGER)"}, lambda c: {"n": text.word_count(c)})
_select("i09_char_length", {"n": "CAST(length(text) AS INTEGER)"}, lambda c: {"n": text.char_length(c)})
_select("i10_average_word_length", {"mean": f"round({t.s_average('text')}, 6)"}, lambda c: {"mean": text.average_word_length(c)}, 6)
_select("i11_count_characters", {n: t.s_count("text", ch) for n, ch in (("bangs", "!"), ("asks", "?"), ("dots", "."))},
        lambda c: {"bangs": text.count_char(c, "!"), "asks": text.count_char(c, "?"), "dots": text.count_char(c, ".")})
_select("i12_has_marks", {"has_question": "contains(text, '?')", "has_exclamation": "contains(text, '!')"},
        lambda c: {"has_question": text.has_char(c, "?"), "has_exclamation": text.has_char(c, "!")})
_select("i13_sentence_count", {"n": f"{t.s_count('text', '.')} + {t.s_count('text', '!')} + {t.s_count('text', '?')}"}, lambda c: {"n": text.sentence_count(c)})
_select("i14_ai_keyword_count", {"n": t.s_hits("text")}, lambda c: {"n": keywords.distinct_hits(c)})
_select("i15_remove_stop_words", {"out": t.s_without("text", vocab.STOP_WORDS)}, lambda c: {"out": text.remove_stop_words(c, vocab.STOP_WORDS)})


@query("i16_lemmatise", f"""SELECT doc_id, coalesce(array_to_string(list_transform({t.s_tokens('lower(text)')}, lambda w: CASE w {' '.join(
    f"WHEN '{a}' THEN '{b}'" for a, b in t.LEMMAS)} ELSE w END), ' '), '') AS lemmatised FROM documents""")
def i16(spark, sf):
    d = t.table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    return lemmas.lemmatise(d, "text", t.lemma_table(spark)).drop("text")


_PROFILES = {
    "basic": t.s_basic("text"), "standard": t.s_standard("text"), "aggressive": t.s_lemmas(t.s_without(t.s_standard("text"), vocab.STOP_WORDS)),
    "tfidf": t.s_lemmas(t.s_tfidf("text", vocab.STOP_WORDS)), "minimal": t.s_minimal("text"), "platform_b": t.s_platform_b("text"),
}


@query("i17_cleaning_profiles", f"SELECT doc_id, {', '.join(f'{c} AS {n}' for n, c in _PROFILES.items())} FROM documents")
def i17(spark, sf):
    d = t.table(spark, sf, "documents").select("doc_id", "text")
    return text.with_profiles(d, "text", vocab.STOP_WORDS, lemmas.dictionary(t.lemma_table(spark))).drop("text")


_select("i18_truncate", {"short": "CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END"}, lambda c: {"short": text.truncate(c, 100)})


@query("i19_concat_and_case", "SELECT doc_id, 'reddit_comment_' || doc_id AS id, coalesce(l.tag, '') || ' ' || text AS full_text, upper(left(lang, 1)) || lower(substring(lang, 2)) AS title, upper(lang) AS upper "
       "FROM documents LEFT JOIN (SELECT doc_id, 'Q' || quality AS tag FROM labels) l USING (doc_id)")
def i19(spark, sf):
    tags = t.table(spark, sf, "labels").select("doc_id", F.concat(F.lit("Q"), "quality").alias("tag"))
    d = t.table(spark, sf, "documents").join(tags, "doc_id", "left")
    return d.select(
        "doc_id", F.concat(F.lit("reddit_comment_"), "doc_id").alias("id"),
        F.concat(F.coalesce("tag", F.lit("")), F.lit(" "), "text").alias("full_text"), F.initcap("lang").alias("title"), F.upper("lang").alias("upper"))


@query("i20_epoch_to_iso", "SELECT event_id, strftime(make_timestamp(event_id * 1000000 * 3600), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso FROM events")
def i20(spark, sf):
    return t.table(spark, sf, "events").select("event_id", calendar.iso_text(calendar.from_epoch(F.col("event_id") * 3600)).alias("iso"))


@query("i21_parse_iso", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS parsed FROM events""")
def i21(spark, sf):
    """Every third text is unreadable, the others end in Z or a numeric zone."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.col("event_id") % 3 == 0, F.lit("bad")).when(F.col("event_id") % 3 == 1, F.concat(iso, F.lit("Z"))).otherwise(F.concat(iso, F.lit("+00:00")))
    return dates_as_text(t.table(spark, sf, "events").select("event_id", calendar.parse_iso(raw).alias("parsed")))


@query("i22_date_parts", "SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(hour(ts) AS INTEGER) AS hour, strftime(ts, '%Y-%m-%d') AS date FROM events")
def i22(spark, sf):
    p = calendar.parts("ts")
    return dates_as_text(t.table(spark, sf, "events").select("event_id", *[p[k].alias(k) for k in ("year", "month", "hour")], F.to_date("ts").alias("date")))


@query("i23_weekday", "SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week FROM events")
def i23(spark, sf):
    return t.table(spark, sf, "events").select("event_id", calendar.parts("ts")["day_of_week"].alias("day_of_week"))


@query("i24_month_name", "SELECT o_orderkey, monthname(o_orderdate) AS month_name FROM orders")
def i24(spark, sf):
    return t.table(spark, sf, "orders").select("o_orderkey", calendar.month_name("o_orderdate").alias("month_name"))


@query("i25_engagement", f"""WITH {t.COMMENTS} SELECT doc_id, score, CASE WHEN score > -1 THEN round(ln(1 + score), 6) END AS log
  FROM (SELECT doc_id, likes - 25 + replies * 2 AS score FROM comments)""")
def i25(spark, sf):
    c = t.comments(spark, sf).select("doc_id", scores.engagement(F.col("likes") - 25, "replies").alias("score"))
    return rounded(c.withColumn("log", scores.engagement_log("score")))


@query("i26_abs_cap_round", f"WITH {t.EVENTS} SELECT event_id, round(abs(compound), 6) AS magnitude, round(least(abs(compound) * 20, 1.0), 6) AS capped, round_even(value * 2, 0) AS even FROM ev")
def i26(spark, sf):
    return rounded(t.events(spark, sf).select(
        "event_id", scores.magnitude("compound").alias("magnitude"), F.least(F.abs("compound") * 20, F.lit(1.0)).alias("capped"),
        F.bround(F.col("value") * 2, 0).alias("even")))


@query("i27_sentiment_label", f"WITH {t.EVENTS} SELECT event_id, label, is_positive, is_negative, is_neutral FROM ev")
def i27(spark, sf):
    return t.events(spark, sf).select("event_id", "label", "is_positive", "is_negative", "is_neutral")


@query("i28_percent_of_total", "SELECT o_orderkey, round(CASE WHEN n = 0 THEN NULL ELSE o_totalprice * 100.0 / n END, 4) AS pct FROM (SELECT *, o_orderkey % 3 AS n FROM orders)")
def i28(spark, sf):
    return rounded(t.table(spark, sf, "orders").select("o_orderkey", scores.share("o_totalprice", F.col("o_orderkey") % 3).alias("pct")), 4)


_select("i29_membership", {
    "has_stop": f"list_has_any({t.s_tokens('lower(text)')}, [{t.in_list(['the', 'der', 'que'])}])", "listed": "lang IN ('en', 'fr')",
}, lambda c: {"has_stop": F.arrays_overlap(text.tokens(F.lower(c)), F.array(*[F.lit(w) for w in ("the", "der", "que")])), "listed": F.col("lang").isin("en", "fr")})


@query("i30_probability_map", f"WITH {t.PREDICTIONS} SELECT doc_id, round(prob_negative, 6) AS negative, round(prob_positive, 6) AS positive, 3 AS n FROM preds")
def i30(spark, sf):
    p = t.predictions(spark, sf).select("doc_id", models.class_probabilities(t.LABELS).alias("m"))
    return rounded(p.select("doc_id", F.col("m")["negative"].alias("negative"), F.col("m")["positive"].alias("positive"), F.size("m").alias("n")))


_select("i31_sentence_split", {"n": "CAST(len(string_split_regex(text, '[.!?]+')) AS INTEGER)", "first": "string_split_regex(text, '[.!?]+')[1]"},
        lambda c: {"n": F.size(text.sentences(c)), "first": F.get(text.sentences(c), F.lit(0))})
_select("i32_strip_accents", {"out": "strip_accents(text)"}, lambda c: {"out": text.strip_accents(c)})
_select("i32_strip_accents_latin1", {"out": "strip_accents(text)"}, lambda c: {"out": text.strip_accents_latin1(c)})
_select("j02_subjectivity", {"score": f"round({t.s_subjectivity('text', '((doc_id * 37) % 201 - 100) / 100.0::DOUBLE')}, 6)"},
        lambda c: {"score": scores.subjectivity(c, ((F.col("doc_id") * 37) % 201 - 100) / F.lit(100.0))}, 6)


@query("o05_percent_text", f"WITH {t.LABELLED} SELECT label, printf('%.1f%%', round_even(count(*) * 100.0 / sum(count(*)) OVER (), 1)) AS shown FROM comments GROUP BY label")
def o05(spark, sf):
    from opinara.operators.aggregates import value_shares

    return value_shares(t.labelled(spark, sf), "label").select("label", F.format_string("%.1f%%", F.bround("pct", 1)).alias("shown"))
