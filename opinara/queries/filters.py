"""Queries for predicates, filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara import vocab
from opinara.functions import keywords, text
from opinara.operators import joins, polarity, relevance, terms
from opinara.queries import tables as t
from opinara.queries.registry import query, rounded


def _documents(spark, sf):
    return t.table(spark, sf, "documents")


@query("c01_contains_ai", f"SELECT doc_id, {t.s_any('text', vocab.AI_KEYWORDS)} AS hit FROM documents")
def c01(spark, sf):
    return _documents(spark, sf).select("doc_id", keywords.contains_any("text", vocab.AI_KEYWORDS).alias("hit"))


@query("c02_contains_opinion", f"SELECT doc_id, {t.s_any('text', vocab.OPINION_KEYWORDS)} AS hit FROM documents")
def c02(spark, sf):
    return _documents(spark, sf).select("doc_id", keywords.contains_any("text", vocab.OPINION_KEYWORDS).alias("hit"))


@query("c03_contains_societal", f"""SELECT doc_id, {t.s_any('text', vocab.SOCIETAL_KEYWORDS)} AS narrow,
  {t.s_any('text', vocab.SOCIETAL_KEYWORDS_WIDE)} AS wide FROM documents""")
def c03(spark, sf):
    return _documents(spark, sf).select(
        "doc_id", keywords.contains_any("text", vocab.SOCIETAL_KEYWORDS).alias("narrow"),
        keywords.contains_any("text", vocab.SOCIETAL_KEYWORDS_WIDE).alias("wide"))


@query("c04_phrase_all_words", """SELECT doc_id, (contains(lower(text), 'the') AND contains(lower(text), 'with'))
  OR (contains(lower(text), 'der') AND contains(lower(text), 'und')) OR contains(lower(text), 'que') AS hit FROM documents""")
def c04(spark, sf):
    return _documents(spark, sf).select("doc_id", keywords.contains_any_phrase("text", ["the with", "der und", "QUE"]).alias("hit"))


@query("c05_mentions_ai", f"""SELECT doc_id, {t.s_word('text', vocab.AI_WHOLE_WORDS)} OR {t.s_any('text', vocab.AI_PHRASES)} AS hit,
  {t.s_word('text', ['is', 'der', 'la'])} OR {t.s_any('text', ['of the', 'en la'])} AS common_hit FROM documents""")
def c05(spark, sf):
    return _documents(spark, sf).select(
        "doc_id", keywords.mentions_ai("text").alias("hit"),
        keywords.mentions_ai("text", ["is", "der", "la"], ["of the", "en la"]).alias("common_hit"))


_TOPICAL = f"({t.s_any('text', t.AI_WORDS)} AND ({t.s_any('text', t.OPINION_WORDS)} OR {t.s_any('text', t.SOCIETAL_WORDS)}))"
_LISTS = {"ai": t.AI_WORDS, "opinion": t.OPINION_WORDS, "societal": t.SOCIETAL_WORDS}


@query("c06_relevant_posts", f"""WITH {t.COMMENTS} SELECT doc_id FROM comments WHERE {t.s_words('text')} BETWEEN 10 AND 1500 AND {_TOPICAL}
  AND {t.s_subjectivity('text', 'compound')} >= 0.3""")
def c06(spark, sf):
    return t.comments(spark, sf).where(relevance.relevant_post(F.col("text"), "compound", **_LISTS)).select("doc_id")


@query("c07_relevant_comments_a", f"SELECT doc_id FROM documents WHERE {t.s_words('text')} BETWEEN 10 AND 300 AND {_TOPICAL}")
def c07(spark, sf):
    return _documents(spark, sf).where(relevance.relevant_comment_a(F.col("text"), **_LISTS)).select("doc_id")


@query("c08_relevant_comments_b", f"""WITH {t.COMMENTS}, cleaned AS (SELECT doc_id, compound, {t.s_platform_b('text')} AS c FROM comments)
  SELECT doc_id FROM cleaned WHERE {t.s_words('c')} BETWEEN 10 AND 300
  AND len(list_filter(string_split_regex(c, '[.!?]+'), lambda s: length({t.s_replace('s', f'^{t.SPACE}+|{t.SPACE}+$')}) > 5)) >= 1
  AND ({t.s_word('c', ['is', 'der', 'la'])} OR {t.s_any('c', ['of the'])})
  AND ({t.s_any('c', t.OPINION_WORDS)} OR {t.s_any('c', t.SOCIETAL_WORDS)}) AND {t.s_subjectivity('c', 'compound')} >= 0.15""")
def c08(spark, sf):
    cleaned = t.comments(spark, sf).select("doc_id", "compound", text.clean_platform_b("text").alias("c"))
    keep = relevance.relevant_comment_b(
        "c", "compound", ai=(["is", "der", "la"], ["of the"]), opinion=t.OPINION_WORDS, societal=t.SOCIETAL_WORDS)
    return cleaned.where(keep).select("doc_id")


@query("c09_present_bodies", "SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND text <> '' AND text NOT IN ('[deleted]', '[removed]')")
def c09(spark, sf):
    return t.table(spark, sf, "conversations").where(relevance.present_body("text")).select("conv_id", "turn")


@query("c10_date_range", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'")
def c10(spark, sf):
    return t.table(spark, sf, "events").where(relevance.in_date_range("ts", "2024-01-10 00:00:00", "2024-01-20 12:00:00")).select("event_id")


@query("c11_engaged_posts", """SELECT o_orderkey FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) l
  ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND n >= 5""")
def c11(spark, sf):
    sizes = t.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    posts = t.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("is_self"))
    return posts.join(sizes, "o_orderkey").where(relevance.engaged_post("is_self", "n")).select("o_orderkey")


@query("c12_drop_null_critical", f"""SELECT d.doc_id, d.text AS cleaned_text, CAST(l.quality AS VARCHAR) AS sentiment FROM documents d
  LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.text IS NOT NULL AND l.quality IS NOT NULL""")
def c12(spark, sf):
    d = _documents(spark, sf).join(t.table(spark, sf, "labels"), "doc_id", "left")
    return relevance.drop_null_critical(d.select("doc_id", F.col("text").alias("cleaned_text"), F.col("quality").cast("string").alias("sentiment")))


@query("c13_drop_empty_text", """SELECT count(*) AS n_before, count(*) FILTER (length(c) = 0) AS n_removed, count(*) FILTER (length(c) > 0) AS n_after
  FROM (SELECT CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) < 50 THEN '' ELSE props END AS c FROM events)""")
def c13(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    e = t.table(spark, sf, "events").select(F.when(k < 50, "").otherwise(F.col("props")).alias("text_clean"))
    return relevance.removed_report(e)


@query("c14_class_masks", f"""WITH {t.LABELLED} SELECT count(*) FILTER (label = 'positive') AS positive, count(*) FILTER (source = 'en') AS english,
  round(avg(likes) FILTER (label = 'negative'), 6) AS likes_negative FROM comments""")
def c14(spark, sf):
    return rounded(t.labelled(spark, sf).agg(
        F.count_if(F.col("label") == "positive").alias("positive"), F.count_if(F.col("source") == "en").alias("english"),
        F.avg(F.when(F.col("label") == "negative", F.col("likes"))).alias("likes_negative")))


@query("c15_search_expression", f"""SELECT doc_id FROM documents WHERE {t.s_any("source || ' ' || text", ['the', 'der'])}
  AND {t.s_any("source || ' ' || text", ['best', 'que', 'src1'])}""")
def c15(spark, sf):
    return _documents(spark, sf).where(keywords.matches_search(["source", "text"], [["the", "der"], ["best", "que", "src1"]])).select("doc_id")


@query("c16_valid_sentences", f"""SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: length({t.s_replace('s', f'^{t.SPACE}+|{t.SPACE}+$')}) > 5)) AS INTEGER) AS n
  FROM documents""")
def c16(spark, sf):
    return _documents(spark, sf).select("doc_id", text.valid_sentences("text").alias("n"))


@query("c17_only_missing", """SELECT * FROM (SELECT 'quality' AS "column", count(*) - count(quality) AS missing, round((count(*) - count(quality)) * 100.0 / count(*), 6) AS pct
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE missing > 0""")
def c17(spark, sf):
    from opinara.operators.aggregates import missing_report

    d = _documents(spark, sf).join(t.table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "lang", "quality")
    return rounded(missing_report(d, only_missing=True))


# --- joins --------------------------------------------------------------------------------------------


@query("d01_comment_with_video", "SELECT o_orderkey, c_custkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def d01(spark, sf):
    orders = t.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return joins.with_metadata(orders, t.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")


@query("d02_comment_with_post", "SELECT l_orderkey AS o_orderkey, l_linenumber, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def d02(spark, sf):
    lines = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return rounded(joins.with_metadata(lines, t.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey"), 2)


@query("d03_prediction_with_text", f"""WITH {t.PREDICTIONS} SELECT p.doc_id, predicted, coalesce(d.text, 'N/A') AS text
  FROM preds p LEFT JOIN (SELECT * FROM documents WHERE lang = 'en') d ON p.doc_id = d.doc_id""")
def d03(spark, sf):
    originals = _documents(spark, sf).where("lang = 'en'")
    return joins.prediction_text(t.predictions(spark, sf).select("doc_id", "predicted"), originals, "doc_id", "text")


@query("d04_side_by_side", f"WITH {t.PREDICTIONS} SELECT doc_id, actual, predicted, round(prob_positive, 6) AS prob_positive FROM preds")
def d04(spark, sf):
    p = t.predictions(spark, sf)
    return rounded(joins.side_by_side(p.select("doc_id", "actual", "predicted"), p.select("doc_id", "prob_positive"), "doc_id"))


@query("d05_feature_stack", f"""WITH {t.COMMENTS} SELECT doc_id, CAST(likes AS DOUBLE) AS f0, CAST(replies AS DOUBLE) AS f1, round(compound, 6) AS f2 FROM comments""")
def d05(spark, sf):
    from pyspark.ml.functions import vector_to_array

    stacked = terms.assemble(terms.assemble(t.comments(spark, sf), ["likes", "replies"], "pair"), ["pair", "compound"])
    values = vector_to_array("features")
    return rounded(stacked.select("doc_id", *[F.get(values, F.lit(i)).alias(f"f{i}") for i in range(3)]))


_LEXICON_SQL = "lexicon(token, valence) AS (VALUES " + ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in t.LEXICON) + ")"


@query("d06_token_lexicon_join", f"""WITH {_LEXICON_SQL}, tok AS (SELECT unnest({t.s_tokens('lower(text)')}) AS token FROM documents)
  SELECT token, count(*) AS n, round(sum(valence), 4) AS total FROM tok JOIN lexicon USING (token) GROUP BY token""")
def d06(spark, sf):
    words = _documents(spark, sf).select(F.explode_outer(text.tokens(F.lower("text"))).alias("token"))
    hits = words.join(polarity.sized_lexicon(t.lexicon(spark)), "token")
    return rounded(hits.groupBy("token").agg(F.count("*").alias("n"), F.sum("valence").alias("total")), 4)


@query("d07_label_decode", f"WITH {t.LABELLED} SELECT doc_id, CASE label WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS label_index, label AS decoded FROM comments")
def d07(spark, sf):
    from opinara.operators.splits import class_index

    return joins.decode(class_index(t.labelled(spark, sf).select("doc_id", "label"), "label"), "label_index", t.LABELS, "decoded").drop("label")
