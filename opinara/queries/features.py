"""Queries for term features, scaling, encoding, splits and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara import vocab
from opinara.operators import splits, terms
from opinara.queries import tables as t
from opinara.queries.registry import query, rounded

_WORDS = f"list_filter(regexp_extract_all(strip_accents(lower(text)), '[{t.W}]{{2,}}'), lambda w: w NOT IN ({t.in_list(vocab.STOP_WORDS)}))"
_TERMS = f"""WITH {t.COMMENTS}, w AS (SELECT doc_id, {_WORDS} AS words FROM comments),
  pairs AS (SELECT doc_id, list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS terms FROM w),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM pairs) GROUP BY 1, 2),
  n AS (SELECT count(*) AS n FROM comments),
  stats AS (SELECT term, CAST(sum(tf) AS BIGINT) AS n, count(*) AS n_docs FROM tf GROUP BY term)"""


def _vocabulary(k: int, min_df: int, max_df: float) -> str:
    return f"""{_TERMS}, kept AS (SELECT * FROM stats WHERE n_docs >= {min_df} AND n_docs <= {max_df}::DOUBLE * (SELECT n FROM n) ORDER BY n DESC, term LIMIT {k}),
      voc AS (SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS index, term, n, n_docs FROM kept)"""


@query("k01_tokens", f"WITH {t.COMMENTS} SELECT doc_id, CAST(len({_WORDS}) AS INTEGER) AS n, coalesce(array_to_string({_WORDS}, ' '), '') AS words FROM comments")
def k01(spark, sf):
    found = terms.words(F.col("text"), vocab.STOP_WORDS)
    return t.comments(spark, sf).select("doc_id", F.size(found).alias("n"), F.array_join(found, " ").alias("words"))


@query("k02_ngrams", f"{_TERMS} SELECT doc_id, CAST(len(terms) AS INTEGER) AS n, coalesce(array_to_string(terms, '|'), '') AS terms FROM pairs")
def k02(spark, sf):
    found = terms.terms(F.col("text"), vocab.STOP_WORDS, 2)
    return t.comments(spark, sf).select("doc_id", F.size(found).alias("n"), F.array_join(found, "|").alias("terms"))


@query("k03_count_vectors", f"{_vocabulary(1000, 1, 1.0)} SELECT doc_id, term, CAST(tf AS DOUBLE) AS weight FROM tf JOIN voc USING (term)")
def k03(spark, sf):
    return terms.tfidf_table(t.comments(spark, sf), "doc_id", "text", 1000, 1, 1.0, vocab.STOP_WORDS, tfidf=False)


def _tfidf_sql(k: int, min_df: int, max_df: float) -> str:
    return f"""{_vocabulary(k, min_df, max_df)}, raw AS (SELECT doc_id, term, tf * (ln((1 + (SELECT n FROM n)) / (1 + n_docs)) + 1) AS x FROM tf JOIN voc USING (term))
      SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw"""


@query("k04_tfidf", _tfidf_sql(5000, 5, 0.8))
def k04(spark, sf):
    return rounded(terms.tfidf_table(t.comments(spark, sf), "doc_id", "text", 5000, 5, 0.8, vocab.STOP_WORDS))


@query("k04_tfidf_small", _tfidf_sql(1000, 1, 1.0))
def k04_small(spark, sf):
    return rounded(terms.tfidf_table(t.comments(spark, sf), "doc_id", "text", 1000, 1, 1.0, vocab.STOP_WORDS))


@query("k05_vocabulary", f"{_vocabulary(5000, 5, 0.8)} SELECT * FROM voc")
def k05(spark, sf):
    return terms.vocabulary(t.comments(spark, sf), "text", 5000, 5, 0.8, vocab.STOP_WORDS)


@query("k06_scaling", f"""WITH {t.FEATURES} SELECT doc_id, round((text_length - avg(text_length) OVER ()) / stddev_pop(text_length) OVER (), 6) AS text_length_scaled,
  round((word_count - avg(word_count) OVER ()) / stddev_pop(word_count) OVER (), 6) AS word_count_scaled, 0.0::DOUBLE AS one_scaled FROM features""")
def k06(spark, sf):
    f = t.features(spark, sf).withColumn("one", F.lit(1.0))
    return rounded(terms.scale(f, ["text_length", "word_count", "one"]).select("doc_id", "text_length_scaled", "word_count_scaled", "one_scaled"))


@query("k07_assembled_features", f"""{_vocabulary(1000, 1, 1.0)}, f AS (SELECT doc_id, length(text) AS len FROM comments)
  SELECT f.doc_id, 1001 AS size, CAST(coalesce(max(x.s), 0) AS DOUBLE) AS term_total, round(max((len - m) / sd), 6) AS length_scaled FROM f
  CROSS JOIN (SELECT avg(len) AS m, stddev_pop(len) AS sd FROM f) LEFT JOIN (SELECT doc_id, sum(tf) AS s FROM tf JOIN voc USING (term) GROUP BY doc_id) x ON x.doc_id = f.doc_id GROUP BY f.doc_id""")
def k07(spark, sf):
    from pyspark.ml.functions import vector_to_array

    c = t.comments(spark, sf).select("doc_id", "text", F.length("text").alias("len"))
    model = terms.fit_terms(c, "text", 1000, 1, 1.0, vocab.STOP_WORDS, tfidf=False)
    stacked = terms.assemble(model.transform(terms.scale(c, ["len"])), [model.output, "len_scaled"])
    values = vector_to_array("features")
    size = F.size(values)
    rest = F.aggregate(F.slice(values, F.lit(1), size - 1), F.lit(0.0), lambda acc, x: acc + x)
    return rounded(stacked.select("doc_id", size.alias("size"), rest.alias("term_total"), F.get(values, size - 1).alias("length_scaled")))


@query("k08_label_encoding", f"WITH {t.LABELLED} SELECT doc_id, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_index FROM comments")
def k08(spark, sf):
    return splits.class_index(t.labelled(spark, sf).select("doc_id", "label"), "label").drop("label")


def _split_sql(cases: str) -> str:
    return f"""WITH {t.LABELLED} SELECT doc_id, label, CASE {cases} ELSE 'train' END AS split FROM (
      SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || ':42')) AS rn, count(*) OVER (PARTITION BY label) AS total FROM comments)"""


@query("k09_stratified_split", _split_sql("WHEN rn <= round(total * 0.2::DOUBLE) THEN 'test'"))
def k09(spark, sf):
    return splits.stratified_split(t.labelled(spark, sf).select("doc_id", "label"), "doc_id", "label", {"test": 0.2})


@query("k10_three_way_split", _split_sql("WHEN rn <= round(total * 0.15::DOUBLE) THEN 'test' WHEN rn <= round(total * 0.3::DOUBLE) THEN 'validation'"))
def k10(spark, sf):
    return splits.stratified_split(t.labelled(spark, sf).select("doc_id", "label"), "doc_id", "label", {"test": 0.15, "validation": 0.15})


@query("k11_class_weights", f"WITH {t.LABELLED} SELECT label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM comments GROUP BY label")
def k11(spark, sf):
    return rounded(splits.class_weights(t.labelled(spark, sf), "label"))


@query("k11_row_weights", f"WITH {t.LABELLED} SELECT doc_id, round(count(*) OVER () / ((SELECT count(DISTINCT label) FROM comments) * count(*) OVER (PARTITION BY label)), 6) AS class_weight FROM comments")
def k11_rows(spark, sf):
    return rounded(splits.with_class_weight(t.labelled(spark, sf).select("doc_id", "label"), "label").drop("label"))
