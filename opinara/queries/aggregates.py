"""Queries for descriptive aggregates and time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara import vocab
from opinara.operators import aggregates as a
from opinara.functions import text
from opinara.operators import relevance, trends, words
from opinara.plans import summary
from opinara.queries import tables as t
from opinara.queries.registry import dates_as_text, query, rounded

_FEATURES = ["text_length", "word_count", "avg_word_length", "ai_keyword_count", "exclamation_count", "question_count"]


def _r(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits})"


def _by_rows(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


@query("e01_value_counts", f"WITH {t.LABELLED} SELECT label, count(*) AS n FROM comments GROUP BY label")
def e01(spark, sf):
    return a.value_counts(t.labelled(spark, sf), "label")


@query("e02_value_shares", f"WITH {t.LABELLED} SELECT label, count(*) AS n, {_r('count(*) * 100.0 / sum(count(*)) OVER ()')} AS pct FROM comments GROUP BY label")
def e02(spark, sf):
    return rounded(a.value_shares(t.labelled(spark, sf), "label"))


@query("e03_counts_by_year", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1")
def e03(spark, sf):
    return trends.yearly_counts(t.table(spark, sf, "orders"), "o_orderdate")


@query("e04_counts_by_year_and_class", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def e04(spark, sf):
    return trends.yearly_counts(t.table(spark, sf, "orders"), "o_orderdate", ["o_orderstatus"])


_E05 = {"avg_likes": "likes", "avg_replies": "replies", "avg_engagement": "engagement_score", "avg_words": "word_count"}


@query("e05_group_stats", f"WITH {t.FEATURES} SELECT source, count(text) AS n, " + ", ".join(f"round_even(avg({c}), 2) AS {o}" for o, c in _E05.items()) + " FROM features GROUP BY source")
def e05(spark, sf):
    return a.group_stats(t.features(spark, sf), "source", "text", _E05)


@query("e06_group_means", f"WITH {t.FEATURES} SELECT label, {_r('avg(word_count)')} AS mean_word_count, {_r('avg(compound)')} AS mean_compound FROM features GROUP BY label")
def e06(spark, sf):
    return rounded(a.group_means(t.features(spark, sf), ["label"], ["word_count", "compound"]))


@query("e07_group_means_sorted", f"WITH {t.FEATURES} SELECT label, {_r('avg(engagement_score)')} AS mean_engagement_score FROM features GROUP BY label")
def e07(spark, sf):
    return rounded(a.group_means(t.features(spark, sf), ["label"], ["engagement_score"])).orderBy("mean_engagement_score", "label")


@query("e08_class_share_by_source", f"""WITH {t.LABELLED} SELECT source, {', '.join(
    _r(f"count(*) FILTER (label = '{x}') * 100.0 / count(*)") + f' AS {x}' for x in t.LABELS)}
  FROM (SELECT *, {t.s_basic('text')} AS text_clean FROM comments) WHERE {t.s_words('text_clean')} > 0 GROUP BY source""")
def e08(spark, sf):
    """Cleaned, non-empty comments: share of every class by source."""
    c = relevance.drop_empty_text(t.labelled(spark, sf).withColumn("text_clean", text.clean_basic("text")))
    return rounded(a.crosstab(c, "source", "label", t.LABELS))


@query("e08_crosstab_counts", f"WITH {t.LABELLED} SELECT community, {', '.join(f'count(*) FILTER (label = {t.q(x)}) AS {x}' for x in t.LABELS)} FROM comments GROUP BY community")
def e08_counts(spark, sf):
    return a.crosstab(t.labelled(spark, sf), "community", "label", t.LABELS, percent=False)


def _summary_sql(source: str, columns: list[str], quartiles: bool = False, total: bool = True) -> str:
    extra = ""
    if quartiles:
        extra = ", " + ", ".join(f"{_r(f'quantile_cont(CAST({{c}} AS DOUBLE), {p})')} AS {n}" for n, p in a.QUARTILES.items())
    parts = []
    for c in columns:
        q = extra.replace("{c}", c)
        s = f", {_r(f'CAST(sum({c}) AS DOUBLE)')} AS sum" if total else ""
        parts.append(
            f"SELECT '{c}' AS measure, count({c}) AS count, {_r(f'avg({c})')} AS mean, {_r(f'stddev_samp({c})')} AS std, "
            f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max{s}{q} FROM {source}")
    return _by_rows(parts)


@query("e09_summary", f"WITH {t.FEATURES} " + _summary_sql("features", ["likes", "replies", "word_count", "compound"]))
def e09(spark, sf):
    return rounded(a.summary(t.features(spark, sf), ["likes", "replies", "word_count", "compound"]))


@query("e09_medians", f"WITH {t.FEATURES} " + _by_rows([f"SELECT '{c}' AS measure, {_r(f'median({c})')} AS median FROM features" for c in ("likes", "replies", "word_count")]))
def e09_medians(spark, sf):
    return rounded(a.medians(t.features(spark, sf), ["likes", "replies", "word_count"]))


@query("e10_describe", _summary_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"], True, False).replace(", 6) AS mean", ", 4) AS mean").replace(", 6) AS std", ", 4) AS std"))
def e10(spark, sf):
    d = a.describe(t.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(d).withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("e11_distinct_counts", "SELECT count(DISTINCT user_id) AS user_id, count(DISTINCT event_type) AS event_type, count(DISTINCT props) AS props FROM events")
def e11(spark, sf):
    return a.distinct_counts(t.table(spark, sf, "events"), ["user_id", "event_type", "props"])


@query("e12_missing_report", f"""WITH j AS (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) """ + _by_rows([
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, {_r(f'(count(*) - count({c})) * 100.0 / count(*)')} AS pct FROM j" for c in ("doc_id", "lang", "quality", "toxic")]))
def e12(spark, sf):
    return rounded(a.missing_report(_labelled_or_not(spark, sf)))


def _labelled_or_not(spark, sf):
    return t.table(spark, sf, "documents").join(t.table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "lang", "quality", "toxic")


@query("e12_missing_total", "SELECT CAST(2 * count(*) FILTER (l.doc_id IS NULL) AS BIGINT) AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def e12_total(spark, sf):
    return a.missing_total(_labelled_or_not(spark, sf))


@query("e13_duplicate_rows", "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicates FROM documents")
def e13(spark, sf):
    return a.duplicate_rows(t.table(spark, sf, "documents").select("text", "lang"))


@query("e14_correlation_matrix", f"WITH {t.FEATURES} " + _by_rows([
    f"SELECT '{x}' AS feature, " + ", ".join(
        _r(f"CASE WHEN stddev_pop({x}) = 0 OR stddev_pop({y}) = 0 THEN NULL ELSE covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END") + f" AS {y}" for y in _FEATURES) + " FROM features"
    for x in _FEATURES]))
def e14(spark, sf):
    return rounded(a.correlation_matrix(t.features(spark, sf), _FEATURES))


@query("e15_correlation", f"WITH {t.FEATURES} SELECT {_r('corr(compound, engagement_score)')} AS r FROM features")
def e15(spark, sf):
    return rounded(t.features(spark, sf).agg(a.correlation("compound", "engagement_score").alias("r")))


def _monthly_sql(source: str, ts: str, measures: dict[str, str]) -> str:
    return f"""WITH {source}, per AS (SELECT date_trunc('month', {ts}) AS m, count(*) AS n{''.join(f', {e} AS {k}' for k, e in measures.items())} FROM src GROUP BY 1),
      months AS (SELECT unnest(generate_series((SELECT min(m) FROM per), (SELECT max(m) FROM per), INTERVAL 1 MONTH)) AS m)
      SELECT strftime(last_day(CAST(months.m AS DATE)), '%Y-%m-%d') AS month_end, coalesce(n, 0) AS n{''.join(f', round({k}, 6) AS {k}' for k in measures)} FROM months LEFT JOIN per ON per.m = months.m"""


@query("e16_monthly_volume", _monthly_sql("src AS (SELECT * FROM orders)", "o_orderdate", {}))
def e16(spark, sf):
    return dates_as_text(trends.monthly_volume(t.table(spark, sf, "orders"), "o_orderdate"))


@query("e16_monthly_volume_with_gaps", _monthly_sql("src AS (SELECT * FROM orders WHERE o_totalprice > 499500)", "o_orderdate", {}))
def e16_gaps(spark, sf):
    """Very large orders: some months have none."""
    return dates_as_text(trends.monthly_volume(t.table(spark, sf, "orders").where("o_totalprice > 499500"), "o_orderdate"))


@query("e17_monthly_mean", _monthly_sql("src AS (SELECT * FROM orders)", "o_orderdate", {"mean": "avg(o_totalprice)"}).replace("round(mean, 6)", "round(mean, 4)"))
def e17(spark, sf):
    return rounded(dates_as_text(trends.monthly_mean(t.table(spark, sf, "orders"), "o_orderdate", "o_totalprice")), 4)


@query("e18_monthly_shares", _monthly_sql(
    "src AS (SELECT *, CAST(o_orderstatus = 'F' AS INTEGER) AS f, CAST(o_orderstatus = 'O' AS INTEGER) AS o FROM orders)", "o_orderdate",
    {"finished": "sum(f) * 100.0 / count(*)", "open": "sum(o) * 100.0 / count(*)"}))
def e18(spark, sf):
    o = t.table(spark, sf, "orders").withColumns({"f": (F.col("o_orderstatus") == "F").cast("int"), "o": (F.col("o_orderstatus") == "O").cast("int")})
    return rounded(dates_as_text(trends.monthly_shares(o, "o_orderdate", {"finished": "f", "open": "o"})))


_FLAGS = ["contains_ai", "contains_opinion", "contains_societal"]


@query("e19_conditional_means", f"WITH {t.FEATURES} " + _by_rows([f"SELECT '{f}' AS flag, {_r(f'avg(compound) FILTER ({f})')} AS mean FROM features" for f in _FLAGS]))
def e19(spark, sf):
    return rounded(a.conditional_means(t.features(spark, sf), _FLAGS, "compound"))


@query("e20_flag_summary", f"WITH {t.FEATURES} " + _by_rows([f"SELECT '{f}' AS flag, count(*) FILTER ({f}) AS n, {_r(f'count(*) FILTER ({f}) * 100.0 / count(*)')} AS pct FROM features" for f in _FLAGS]))
def e20(spark, sf):
    return rounded(a.flag_summary(t.features(spark, sf), _FLAGS))


@query("e21_share_above_zero", f"WITH {t.FEATURES} SELECT {_r('avg(ai_keyword_count)')} AS mean, {_r('count(*) FILTER (ai_keyword_count > 0) * 100.0 / count(*)')} AS pct FROM features")
def e21(spark, sf):
    return rounded(a.share_above(t.features(spark, sf), "ai_keyword_count"))


_MARKS = ["exclamation_count", "question_count", "period_count"]


@query("e22_punctuation_shares", f"WITH {t.FEATURES} " + _by_rows([
    f"SELECT '{c}' AS \"column\", CAST(sum({c}) AS BIGINT) AS total, {_r(f'sum({c}) * 100.0 / sum(exclamation_count + question_count + period_count)')} AS pct FROM features" for c in _MARKS]))
def e22(spark, sf):
    return rounded(a.sums_and_shares(t.features(spark, sf), _MARKS))


@query("e23_component_means", f"WITH {t.RAW_A} " + _by_rows([f"SELECT '{c}' AS \"column\", {_r(f'avg({c})')} AS mean FROM raw_a" for c in ("sentiment_positive", "sentiment_negative", "sentiment_neutral")]))
def e23(spark, sf):
    return rounded(a.column_means(t.raw_a(spark, sf), ["sentiment_positive", "sentiment_negative", "sentiment_neutral"]))


@query("e24_best_group", f"WITH {t.FEATURES} SELECT label, {_r('avg(engagement_score)')} AS mean FROM features GROUP BY label ORDER BY avg(engagement_score) DESC, label LIMIT 1")
def e24(spark, sf):
    return rounded(a.best_group(t.features(spark, sf), "label", "engagement_score"))


@query("e24_worst_group", f"WITH {t.FEATURES} SELECT community, {_r('avg(engagement_score)')} AS mean FROM features GROUP BY community ORDER BY avg(engagement_score), community LIMIT 1")
def e24_worst(spark, sf):
    return rounded(a.best_group(t.features(spark, sf), "community", "engagement_score", largest=False))


@query("e25_date_span", """SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last,
  CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS BIGINT) AS days, CAST(year(min(ts)) AS INTEGER) AS first_year, CAST(year(max(ts)) AS INTEGER) AS last_year FROM events""")
def e25(spark, sf):
    return dates_as_text(a.date_span(t.table(spark, sf, "events"), "ts"))


def _histogram_sql(source: str, column: str, bins: int, classes: str | None) -> str:
    cls, by = ("class, ", "class") if classes else ("", "1")
    key = classes or "'all'"
    return f"""WITH {source}, v AS (SELECT {key} AS class, CAST({column} AS DOUBLE) AS v FROM src),
      raw_edges AS (SELECT class, min(v) AS lo, max(v) AS hi FROM v GROUP BY class),
      edges AS (SELECT class, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM raw_edges),
      binned AS (SELECT v.class, CAST(least(floor({bins} * (v - lo) / (hi - lo)) + 1, {bins}) AS INTEGER) AS bin, count(*) AS n FROM v JOIN edges USING (class) GROUP BY 1, 2),
      grid AS (SELECT class, CAST(unnest(range(1, {bins + 1})) AS INTEGER) AS bin, lo, (hi - lo) / {bins} AS w FROM edges)
      SELECT {cls} bin, {_r('lo + (bin - 1) * w')} AS from_value, {_r('lo + bin * w')} AS to_value, coalesce(n, 0) AS n FROM grid LEFT JOIN binned USING (class, bin)"""


@query("e26_histogram", _histogram_sql(t.EVENTS + ", src AS (SELECT * FROM ev)", "compound", 50, None))
def e26(spark, sf):
    return rounded(a.histogram(t.events(spark, sf), "compound", 50))


@query("e26_histogram_by_class", _histogram_sql(t.EVENTS + ", src AS (SELECT *, abs(compound) AS mag FROM ev)", "mag", 30, "label"))
def e26_class(spark, sf):
    e = t.events(spark, sf).withColumn("mag", F.abs("compound"))
    return rounded(a.histogram(e, "mag", 30, "label", t.LABELS))


@query("e26_histogram_keyword_count", _histogram_sql(t.FEATURES + ", src AS (SELECT * FROM features)", "ai_keyword_count", 20, None))
def e26_keywords(spark, sf):
    return rounded(a.histogram(t.features(spark, sf), "ai_keyword_count", 20))


@query("e27_box_summary", f"""WITH {t.FEATURES}, qs AS (SELECT label, CAST(quantile_cont(CAST(text_length AS DOUBLE), 0.25) AS DOUBLE) AS q1, quantile_cont(CAST(text_length AS DOUBLE), 0.5) AS median,
    quantile_cont(CAST(text_length AS DOUBLE), 0.75) AS q3 FROM features GROUP BY label),
  f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM qs)
  SELECT label, {_r('q1')} AS q1, {_r('median')} AS median, {_r('q3')} AS q3, CAST(min(text_length) AS DOUBLE) AS min, CAST(max(text_length) AS DOUBLE) AS max,
    CAST(min(text_length) FILTER (text_length BETWEEN lo AND hi) AS DOUBLE) AS whisker_low, CAST(max(text_length) FILTER (text_length BETWEEN lo AND hi) AS DOUBLE) AS whisker_high,
    count(*) FILTER (text_length NOT BETWEEN lo AND hi) AS outliers FROM features JOIN f USING (label) GROUP BY label, q1, median, q3""")
def e27(spark, sf):
    return rounded(a.box_summary(t.features(spark, sf), "label", "text_length"))


@query("e28_flag_distribution", f"WITH {t.FEATURES} SELECT question_count > 0 AS has_question, count(*) AS n FROM features GROUP BY 1")
def e28(spark, sf):
    return a.value_counts(t.features(spark, sf).select((F.col("question_count") > 0).alias("has_question")), "has_question")


_SPLIT_SQL = """split AS (SELECT doc_id, label, CASE WHEN rn <= round(total * 0.2) THEN 'test' ELSE 'train' END AS split FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || ':42')) AS rn, count(*) OVER (PARTITION BY label) AS total FROM comments))"""


@query("e29_split_balance", f"WITH {t.LABELLED}, {_SPLIT_SQL} SELECT split, label, count(*) AS n, {_r('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY split)')} AS pct FROM split GROUP BY split, label")
def e29(spark, sf):
    from opinara.operators.splits import stratified_split

    marked = stratified_split(t.labelled(spark, sf).select("doc_id", "label"), "doc_id", "label", {"test": 0.2})
    return rounded(a.split_balance(marked, "label", "split"))


@query("e30_overall_verdict", f"WITH {t.EVENTS} SELECT {_r('avg(compound)')} AS mean, CASE WHEN avg(compound) > 0.05 THEN 'POSITIVE' WHEN avg(compound) < -0.05 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS verdict FROM ev")
def e30(spark, sf):
    return rounded(a.overall_verdict(t.events(spark, sf), "compound"))


@query("e31_scatter", f"WITH {t.FEATURES} SELECT label AS class, {_r('compound')} AS x, {_r('engagement_log')} AS y FROM features")
def e31(spark, sf):
    return rounded(a.scatter(t.features(spark, sf), "compound", "engagement_log", "label"))


_CLOUD = f"""list_filter(list_transform(regexp_extract_all(lower(text), '[{t.W}][{t.W}'']+'), lambda w: regexp_replace(w, '''s$', '')),
    lambda w: NOT regexp_matches(w, '^\\p{{N}}*$') AND w NOT IN ({t.in_list(vocab.STOP_WORDS)}))"""

_ALL_WORDS = _CLOUD.replace(f" AND w NOT IN ({t.in_list(vocab.STOP_WORDS)})", "")


def _cloud_sql(words_sql: str) -> str:
    return f"""WITH {t.COMMENTS}, w AS (SELECT label, {_CLOUD} AS words FROM comments),
      c AS (SELECT label, word, count(*) AS n FROM (SELECT label, unnest({words_sql}) AS word FROM w) GROUP BY label, word)
      SELECT label, word, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY n DESC, word) AS INTEGER) AS rank FROM c) WHERE rank <= 100"""


@query("e32_word_frequencies", _cloud_sql("words"))
def e32(spark, sf):
    return words.word_frequencies(t.comments(spark, sf), "label", "text", vocab.STOP_WORDS, 100)


@query("e32_word_and_pair_frequencies", _cloud_sql("list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))"))
def e32_pairs(spark, sf):
    return words.word_frequencies(t.comments(spark, sf), "label", "text", vocab.STOP_WORDS, 100, pairs=True)


def _likelihood(k: str, n: str, x: str) -> str:
    return f"(ln(greatest({x}, 1e-10)) * ({k}) + ln(greatest(1 - ({x}), 1e-10)) * (({n}) - ({k})))"


def _plurals(name: str, source: str) -> str:
    single = "ends_with(a.term, 's') AND NOT ends_with(a.term, 'ss') AND b.term = left(a.term, length(a.term) - 1)"
    return f"{name} AS (SELECT a.label, a.term, coalesce(b.term, a.term) AS form, a.n FROM {source} a LEFT JOIN {source} b ON a.label = b.label AND {single})"


_RATIO = f"""-2 * ({_likelihood('p.n', 'a.n', 'b.n / total')} + {_likelihood('b.n - p.n', 'total - a.n', 'b.n / total')}
    - {_likelihood('p.n', 'a.n', 'p.n / a.n')} - {_likelihood('b.n - p.n', 'total - a.n', '(b.n - p.n) / (total - a.n)')})"""
_STOPPED = t.in_list(vocab.STOP_WORDS)


@query("e32_cloud_terms", f"""WITH {t.COMMENTS}, w AS (SELECT label, {_ALL_WORDS} AS words FROM comments),
  u AS (SELECT label, term, count(*) AS n FROM (SELECT label, unnest(words) AS term FROM w) WHERE term NOT IN ({_STOPPED}) GROUP BY ALL),
  {_plurals('s', 'u')}, f AS (SELECT label, form, sum(n) AS n FROM s GROUP BY ALL), tot AS (SELECT label, sum(n) AS total FROM f GROUP BY label),
  b0 AS (SELECT label, x[1] || ' ' || x[2] AS term, count(*) AS n FROM (
    SELECT label, unnest(list_transform(range(1, len(words)), lambda i: [words[i], words[i + 1]])) AS x FROM w)
    WHERE x[1] NOT IN ({_STOPPED}) AND x[2] NOT IN ({_STOPPED}) GROUP BY ALL),
  {_plurals('b1', 'b0')}, pr AS (SELECT label, form AS pair, sum(n) AS n FROM b1 GROUP BY ALL),
  strong AS (
    SELECT p.label, p.pair, p.n, x.form AS first, y.form AS second FROM pr p
    JOIN s x ON x.label = p.label AND x.term = split_part(p.pair, ' ', 1) JOIN s y ON y.label = p.label AND y.term = split_part(p.pair, ' ', 2)
    JOIN f a ON a.label = p.label AND a.form = x.form JOIN f b ON b.label = p.label AND b.form = y.form JOIN tot ON tot.label = p.label
    WHERE total > a.n AND total > b.n AND {_RATIO} > {words.PAIR_SCORE}
  ), parts AS (
    SELECT * FROM f UNION ALL SELECT label, first, -n FROM strong UNION ALL SELECT label, second, -n FROM strong UNION ALL SELECT label, pair, n FROM strong
  ), final AS (SELECT label, form AS word, CAST(sum(n) AS BIGINT) AS n FROM parts GROUP BY ALL HAVING sum(n) > 0)
  SELECT label, word, n, CAST(row_number() OVER (PARTITION BY label ORDER BY n DESC, word) AS INTEGER) AS rank FROM final
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, word) <= 100""")
def e32_cloud(spark, sf):
    """The terms of a word cloud per class: plurals merged, strong pairs as terms of their own."""
    return words.cloud_frequencies(t.comments(spark, sf), "label", "text", vocab.STOP_WORDS, 100)


@query("e33_run_summary", f"WITH {t.FEATURES} " + _by_rows(
    ["SELECT 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM features", "SELECT 'unique_community', CAST(count(DISTINCT community) AS DOUBLE) FROM features"]
    + [f"SELECT 'mean_{c}', {_r(f'avg({c})')} FROM features" for c in ("compound", "word_count", "likes")]
    + [f"SELECT 'total_{c}', CAST(count(*) FILTER ({c}) AS DOUBLE) FROM features" for c in _FLAGS]))
def e33(spark, sf):
    return rounded(summary.run_summary(t.features(spark, sf), ["compound", "word_count", "likes"], ["community"], _FLAGS))
