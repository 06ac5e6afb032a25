"""Queries for projection, schema and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara import vocab
from opinara.functions import scores, text
from opinara.operators import shaping
from opinara.queries import tables as t
from opinara.queries.registry import dates_as_text, query, rounded

_UNIFIED = """text, text_length, sentiment_compound, sentiment_positive, sentiment_negative, sentiment_neutral,
  sentiment_subjectivity, likes, replies, source_id, contains_ai, contains_opinion, contains_societal, platform_post_id,
  platform_post_title, platform_community, platform_post_score, platform_post_engagement, sentiment_label,
  strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, source"""


@query("b01_harmonise_a", f"WITH {t.RAW_A} SELECT {_UNIFIED} FROM ({t.UNIFIED_A})")
def b01(spark, sf):
    return dates_as_text(shaping.harmonise(t.raw_a(spark, sf), vocab.PLATFORM_A))


@query("b02_harmonise_b", f"WITH {t.RAW_B} SELECT {_UNIFIED} FROM ({t.UNIFIED_B})")
def b02(spark, sf):
    return dates_as_text(shaping.harmonise(t.raw_b(spark, sf), vocab.PLATFORM_B))


@query("b03_column_or_derived", f"""WITH {t.COMMENTS} SELECT doc_id, label AS kept, {t.s_label('compound')} AS derived FROM comments""")
def b03(spark, sf):
    c = t.comments(spark, sf)
    derived = scores.sentiment_label("compound")
    return c.select("doc_id", shaping.column_or(c, "label", derived).alias("kept"), shaping.column_or(c, "absent", derived).alias("derived"))


@query("b04_constant_tag", "SELECT doc_id, 'reddit' AS source, 'youtube' AS other FROM documents")
def b04(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", F.lit(vocab.PLATFORM_A).alias("source"), F.lit(vocab.PLATFORM_B).alias("other"))


@query("b05_alias_if_missing", "SELECT doc_id, text AS text_clean, text AS cleaned_text, lang AS sentiment_label, source AS sentiment FROM documents")
def b05(spark, sf):
    d = t.table(spark, sf, "documents").select("doc_id", F.col("text").alias("text_clean"), F.col("lang").alias("sentiment_label"), F.col("source").alias("sentiment"))
    return shaping.alias_if_missing(d)


@query("b06_selected_head", "SELECT text, lang FROM documents ORDER BY doc_id LIMIT 10")
def b06(spark, sf):
    return shaping.head(t.table(spark, sf, "documents"), ["text", "lang"], 10, ["doc_id"])


@query("b07_finalise_types", """SELECT doc_id, strftime(make_timestamp((1577836800 + doc_id * 43200) * 1000000), '%Y-%m-%d %H:%M:%S') AS created_at,
  lang AS source, doc_id % 2 = 1 AS contains_ai FROM documents""")
def b07(spark, sf):
    iso = F.date_format(F.timestamp_seconds(F.lit(1577836800) + F.col("doc_id") * 43200), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    d = t.table(spark, sf, "documents").select("doc_id", iso.alias("created_at"), F.col("lang").alias("source"), (F.col("doc_id") % 2).cast("int").alias("contains_ai"))
    return dates_as_text(shaping.finalise_types(d))


@query("b08_flags_to_int", f"WITH {t.EVENTS} SELECT event_id, is_positive, is_negative, is_neutral FROM ev")
def b08(spark, sf):
    return t.events(spark, sf).select("event_id", "is_positive", "is_negative", "is_neutral")


_DOC_TYPES = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


@query("b09_column_catalogue", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{k}' AS type, count({c}) AS non_null FROM documents" for c, k in _DOC_TYPES.items()))
def b09(spark, sf):
    return shaping.column_catalogue(t.table(spark, sf, "documents"))


@query("b10_numeric_and_text_columns", "SELECT doc_id, n_chars, length(text) + length(lang) + length(source) AS text_size FROM documents")
def b10(spark, sf):
    d = t.table(spark, sf, "documents")
    size = sum((F.length(c) for c in shaping.text_columns(d)[1:]), F.length(shaping.text_columns(d)[0]))
    return d.select(*shaping.numeric_columns(d), size.cast("bigint").alias("text_size"))


@query("b11_type_histogram", "SELECT type, count(*) AS n_columns, CAST(sum(non_null) AS BIGINT) AS non_null FROM (" + " UNION ALL ".join(
    f"SELECT '{k}' AS type, count({c}) AS non_null FROM documents" for c, k in _DOC_TYPES.items()) + ") GROUP BY type")
def b11(spark, sf):
    return shaping.type_histogram(t.table(spark, sf, "documents"))


@query("b12_row_lookup", "SELECT doc_id, text, lang FROM documents ORDER BY doc_id LIMIT 1 OFFSET 3")
def b12(spark, sf):
    return shaping.nth_row(t.table(spark, sf, "documents"), 3, ["doc_id"]).select("doc_id", "text", "lang")


@query("b13_feature_explanation", f"""WITH {t.FEATURES} """ + " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS feature, round(CAST({c} AS DOUBLE), 6) AS value FROM features" for n, c in (
        ("characters", "length(text)"), ("words", t.s_words("text")), ("average_word_length", t.s_average("text")), ("engagement", "engagement_score"))))
def b13(spark, sf):
    c = F.col("text")
    return rounded(shaping.feature_explanation(t.features(spark, sf), "doc_id", {
        "characters": text.char_length(c), "words": text.word_count(c), "average_word_length": text.average_word_length(c),
        "engagement": F.col("engagement_score")}))


_MEANS = "SELECT lang, avg(n_chars) AS mean_chars, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY lang"


@query("b14_transpose", f"""WITH m AS ({_MEANS}) {' UNION ALL '.join(
    f"SELECT '{v}' AS metric, " + ', '.join(f"round(max(CASE WHEN lang = '{x}' THEN {v} END), 6) AS {x}" for x in ('de', 'en', 'es', 'fr')) + ' FROM m'
    for v in ('mean_chars', 'n'))}""")
def b14(spark, sf):
    m = t.table(spark, sf, "documents").groupBy("lang").agg(F.avg("n_chars").alias("mean_chars"), F.count("*").alias("n"))
    return rounded(shaping.transpose(m, "lang", ["de", "en", "es", "fr"], ["mean_chars", "n"]))


@query("b15_wide_to_long", f"""WITH m AS ({_MEANS}) SELECT lang, 'mean_chars' AS metric, round(mean_chars, 6) AS value FROM m
  UNION ALL SELECT lang, 'n', n FROM m""")
def b15(spark, sf):
    m = t.table(spark, sf, "documents").groupBy("lang").agg(F.avg("n_chars").alias("mean_chars"), F.count("*").cast("double").alias("n"))
    return rounded(shaping.to_long(m, ["lang"], ["mean_chars", "n"]))


@query("h01_union_harmonised", f"WITH {t.MERGED} SELECT {_UNIFIED}, source_rank FROM merged")
def h01(spark, sf):
    return dates_as_text(shaping.union_all(
        shaping.harmonise(t.raw_a(spark, sf), vocab.PLATFORM_A), shaping.harmonise(t.raw_b(spark, sf), vocab.PLATFORM_B)))


@query("h02_append_batches", "SELECT doc_id AS id, text FROM documents UNION ALL SELECT conv_id * 1000 + turn, text FROM conversations")
def h02(spark, sf):
    return shaping.union_all(
        t.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"),
        t.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), rank_column=None)


@query("h03_distinct", "SELECT DISTINCT lang, source FROM documents")
def h03(spark, sf):
    return t.table(spark, sf, "documents").select("lang", "source").distinct()
