"""The given tables seen as comments, posts, predictions and raw platform tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara import vocab
from opinara.functions import keywords, scores, text

LABELS = vocab.LABELS
# Words that occur in the given texts, standing in for topic words.
AI_WORDS = ["the", "der", "la"]
OPINION_WORDS = ["that", "que", "und"]
SOCIETAL_WORDS = ["with", "pour", "best"]
RULE_B = {"ai": (["is", "der", "la"], ["of the"]), "opinion": OPINION_WORDS, "societal": SOCIETAL_WORDS}
LEXICON = [
    ("that", 1.5), ("was", -1.2), ("with", 0.8), ("der", -0.9), ("que", 1.1), ("und", 0.6), ("les", -0.7),
    ("for", 2.0), ("no", -1.2), ("best", 3.2), ("it", -0.4), ("on", 0.3),
]
# Expressions that occur in the given texts.
IDIOMS = {"that the": 1.7, "was of the": -0.4, "that of": 0.0, "of the": 2.2}
PHRASES = ["of the", "the of the", "in a"]
LEMMAS = [("was", "be"), ("is", "be"), ("are", "be"), ("les", "le"), ("des", "de"), ("die", "der")]


# Timestamps are read with time zone, which lets filters on them reach the scan.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table under its explicit schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def comments(spark: SparkSession, sf: str, labelled_only: bool = False) -> DataFrame:
    """Every document as a comment. One without a label gets it from its score, or is left out on request."""
    compound = ((F.col("doc_id") * 37) % 201 - 100) / F.lit(100.0)
    label = (
        F.when(F.col("toxic").isNull(), scores.sentiment_label(compound))
        .when(F.col("toxic") == 1, "negative").when(F.col("quality") == 0, "neutral").otherwise("positive")
    )
    return (
        table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "inner" if labelled_only else "left")
        .select(
            "doc_id", "text", F.col("lang").alias("source"), F.col("source").alias("community"),
            label.alias("label"), (F.col("doc_id") % 50).alias("likes"), (F.col("doc_id") % 7).alias("replies"),
            compound.alias("compound"),
        )
    )


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Comments whose label was given."""
    return comments(spark, sf, labelled_only=True)


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a score in place of their value."""
    compound = (F.col("value") - 50) / 500
    return table(spark, sf, "events").withColumn("compound", compound).withColumns({
        "label": scores.sentiment_label("compound"), **scores.polarity_flags("compound"),
    })


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Comments with the text features of the final table."""
    c = comments(spark, sf).withColumn("text_clean", text.clean_basic("text"))
    score = scores.engagement("likes", "replies")
    return c.withColumns({
        "text_length": text.char_length("text_clean"), "word_count": text.word_count("text_clean", collapsed=True),
        "avg_word_length": text.average_word_length("text_clean", collapsed=True),
        "ai_keyword_count": keywords.distinct_hits("text_clean"),
        "exclamation_count": text.count_char("text", "!"), "question_count": text.count_char("text", "?"),
        "period_count": text.count_char("text", "."), "engagement_score": score,
        "engagement_log": scores.engagement_log(score), **scores.polarity_flags("compound"),
        "sentiment_magnitude": scores.magnitude("compound"),
        "contains_ai": keywords.contains_any("text", vocab.AI_KEYWORDS),
        "contains_opinion": keywords.contains_any("text", vocab.OPINION_KEYWORDS),
        "contains_societal": keywords.contains_any("text", vocab.SOCIETAL_KEYWORDS_WIDE),
    })


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with a wrong prediction for every fifth id."""
    moved = F.when(F.col("label") == "negative", "neutral").when(F.col("label") == "neutral", "positive").otherwise("negative")
    base = labelled(spark, sf).select(
        "doc_id", F.col("label").alias("actual"),
        F.when(F.col("doc_id") % 5 == 0, moved).otherwise(F.col("label")).alias("predicted"),
        (0.5 + (F.col("doc_id") % 40) / F.lit(100.0)).alias("p"),
    )
    return base.select("doc_id", "actual", "predicted", *[
        F.when(F.col("predicted") == x, F.col("p")).otherwise((1 - F.col("p")) / 2).alias(f"prob_{x}") for x in LABELS
    ])


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "token string, valence double")


def lemma_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEMMAS, "form string, lemma string")


def raw_a(spark: SparkSession, sf: str) -> DataFrame:
    """Comments in the raw schema of platform A, with a row number ``seq``."""
    d = F.col("doc_id")
    post = d % 97
    created = F.date_format(F.timestamp_seconds(F.lit(1577836800) + d * 43200), "yyyy-MM-dd'T'HH:mm:ssxxx")
    return comments(spark, sf).select(
        d.alias("seq"), "text", text.word_count("text").alias("comment_length"),
        F.col("compound").alias("sentiment_polarity"), (d % 10 / F.lit(10.0)).alias("sentiment_positive"),
        (d % 8 / F.lit(8.0)).alias("sentiment_negative"), (d % 4 / F.lit(4.0)).alias("sentiment_neutral"),
        (d % 5 / F.lit(5.0)).alias("sentiment_subjectivity"), "likes", F.col("replies").cast("int").alias("num_replies"),
        created.alias("created_utc"), F.lit(vocab.PLATFORM_A).alias("source"),
        F.concat(F.lit("reddit_comment_"), d).alias("source_id"), F.concat(F.lit("p"), post).alias("post_id"),
        F.concat(F.lit("Post "), post).alias("post_title"), F.col("community").alias("subreddit"),
        (post * 3).alias("post_score"), (post / F.lit(100.0)).alias("post_upvote_ratio"), post.alias("post_num_comments"),
        created.alias("post_created_utc"),
        keywords.contains_any("text", AI_WORDS).alias("contains_ai"),
        keywords.contains_any("text", OPINION_WORDS).alias("contains_opinion"),
        keywords.contains_any("text", SOCIETAL_WORDS).alias("contains_societal"),
        F.col("label").alias("sentiment_label"),
    )


def raw_b(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns in the raw schema of platform B; the label is left to be derived."""
    seq = F.col("conv_id") * 1000 + F.col("turn")
    video = F.col("conv_id")
    polarity = ((seq * 37) % 201 - 100) / F.lit(100.0)
    created = F.date_format(F.timestamp_seconds(F.lit(1609459200) + F.col("conv_id") * 86400 + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf, "conversations").select(
        seq.alias("seq"), "text", text.word_count("text").alias("comment_length"),
        polarity.alias("sentiment_polarity"), F.lit(0.25).alias("sentiment_positive"),
        F.lit(0.25).alias("sentiment_negative"), F.lit(0.5).alias("sentiment_neutral"),
        F.lit(0.5).alias("sentiment_subjectivity"), (seq % 30).alias("likes"), (seq % 4).cast("int").alias("num_replies"),
        created.alias("created_utc"), F.lit(vocab.PLATFORM_B).alias("source"),
        F.concat(F.lit("youtube_comment_"), seq).alias("source_id"), F.concat(F.lit("v"), video).alias("video_id"),
        F.concat(F.lit("Video "), video).alias("video_title"), F.col("role").alias("video_channel"),
        (video * 100).alias("video_view_count"), (video * 10).alias("video_like_count"),
        video.alias("video_comment_count"), created.alias("video_published_at"),
        keywords.contains_any("text", AI_WORDS).alias("contains_ai"),
        keywords.contains_any("text", OPINION_WORDS).alias("contains_opinion"),
        keywords.contains_any("text", SOCIETAL_WORDS).alias("contains_societal"),
    )


# --- the same in SQL ----------------------------------------------------------------------------------

SPACE = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"
NOT_SPACE = r"[^\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"
W = r"\p{L}\p{N}_"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return ", ".join(q(v) for v in values)


def s_any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), {q(w.lower())})" for w in words) + ")"


def s_word(c: str, words) -> str:
    return f"regexp_matches(lower({c}), '(^|[^{W}])({'|'.join(words)})([^{W}]|$)')"


def s_words(c: str) -> str:
    return f"len(regexp_extract_all({c}, '{NOT_SPACE}+'))"


def s_replace(c: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(to)}, 'g')"


def s_collapse(c: str) -> str:
    return f"trim({s_replace(c, SPACE + '+', ' ')})"


def s_no_noise(c: str) -> str:
    return s_replace(s_replace(f"coalesce({c}, '')", rf"(http|www\.){NOT_SPACE}+"), f"{NOT_SPACE}+@{NOT_SPACE}+")


def s_social(c: str) -> str:
    return f"lower({s_replace(s_replace(s_no_noise(c), f'@[{W}]+'), f'#([{W}]+)', chr(92) + '1')})"


def s_basic(c: str) -> str:
    return s_collapse(s_social(c))


def s_no_punct(c: str) -> str:
    return f"translate({c}, {q(vocab.PUNCTUATION)}, '')"


def s_no_digits(c: str) -> str:
    return s_replace(c, r"\p{Nd}+")


def s_standard(c: str) -> str:
    return s_collapse(s_no_digits(s_no_punct(s_basic(c))))


def s_unsplit(c: str) -> str:
    for pair in vocab.SPLIT_WORDS:
        left, right = pair.split("|")
        # The pattern engine has no look-behind; the words are separated by single spaces here.
        c = s_replace(c, rf"(^|[^{W}])({left})({right})([^{W}]|$)", r"\1\2 \3\4")
    return c


def s_tokens(c: str) -> str:
    return f"list_filter(string_split({s_collapse(c)}, ' '), lambda w: w <> '')"


def s_without(c: str, stop_words) -> str:
    return f"coalesce(array_to_string(list_filter({s_tokens(s_unsplit(c))}, lambda w: lower(w) NOT IN ({in_list(stop_words)})), ' '), '')"


def s_tfidf(c: str, stop_words) -> str:
    return s_without(s_no_digits(s_no_punct(s_social(c))), stop_words)


def s_lemmas(c: str) -> str:
    lemma = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LEMMAS)
    return f"coalesce(array_to_string(list_transform({s_tokens(c)}, lambda w: CASE w {lemma} ELSE w END), ' '), '')"


def s_minimal(c: str) -> str:
    return s_collapse(f"translate({s_no_noise(c)}, '@#', '')")


def s_platform_b(c: str) -> str:
    loose = s_replace(f"coalesce({c}, '')", f"(http|www){NOT_SPACE}+")
    return s_collapse(s_replace(loose, rf"""[^{W}\s\p{{Z}}\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}.,!?'"-]""", " "))


def s_count(c: str, char: str) -> str:
    return f"CAST(length({c}) - length(replace({c}, {q(char)}, '')) AS INTEGER)"


def s_average(c: str) -> str:
    return f"CASE WHEN {s_words(c)} > 0 THEN length({s_replace(c, SPACE + '+')}) / {s_words(c)} ELSE 0.0 END"


def s_label(c: str) -> str:
    return f"CASE WHEN {c} >= 0.05 THEN 'positive' WHEN {c} <= -0.05 THEN 'negative' ELSE 'neutral' END"


def s_flags(c: str) -> str:
    return (
        f"CAST({c} >= 0.05 AS INTEGER) AS is_positive, CAST({c} <= -0.05 AS INTEGER) AS is_negative, "
        f"CAST({c} > -0.05 AND {c} < 0.05 AS INTEGER) AS is_neutral"
    )


def s_hits(c: str) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({c}), {q(k)}) AS INTEGER)" for k in vocab.FEATURE_AI_KEYWORDS) + ")"


def s_relevant_b(c: str, compound: str) -> str:
    """The relevance rule of platform B on cleaned text, over the stand-in words."""
    sentence = f"length({s_replace('s', f'^{SPACE}+|{SPACE}+$')}) > 5"
    return (
        f"{s_words(c)} BETWEEN 10 AND 300 AND len(list_filter(string_split_regex({c}, '[.!?]+'), lambda s: {sentence})) >= 1 "
        f"AND ({s_word(c, RULE_B['ai'][0])} OR {s_any(c, RULE_B['ai'][1])}) "
        f"AND ({s_any(c, OPINION_WORDS)} OR {s_any(c, SOCIETAL_WORDS)}) AND {s_subjectivity(c, compound)} >= 0.15"
    )


def s_subjectivity(c: str, compound: str) -> str:
    found = " + ".join(f"CAST({s_word(c, g)} AS INTEGER) * 0.125::DOUBLE" for g in vocab.SUBJECTIVE_GROUPS)
    return f"least({found} + abs({compound}) * 0.5::DOUBLE, 1.0::DOUBLE)"


def _comments(join: str) -> str:
    compound = "((d.doc_id * 37) % 201 - 100) / 100.0::DOUBLE"
    return f"""comments AS (
  SELECT d.doc_id, d.text, d.lang AS source, d.source AS community,
    CASE WHEN l.toxic IS NULL THEN {s_label(compound)} WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 0 THEN 'neutral' ELSE 'positive' END AS label,
    d.doc_id % 50 AS likes, d.doc_id % 7 AS replies, {compound} AS compound
  FROM documents d {join} JOIN labels l ON d.doc_id = l.doc_id)"""


COMMENTS, LABELLED = _comments("LEFT"), _comments("INNER")

EVENTS = f"""ev AS (SELECT *, {s_label('compound')} AS label, {s_flags('compound')}
  FROM (SELECT *, (value - 50) / 500 AS compound FROM events))"""

FEATURES = f"""{COMMENTS}, features AS (
  SELECT *, CAST(length(text_clean) AS INTEGER) AS text_length, CAST({s_words('text_clean')} AS INTEGER) AS word_count,
    {s_average('text_clean')} AS avg_word_length, {s_hits('text_clean')} AS ai_keyword_count,
    {s_count('text', '!')} AS exclamation_count, {s_count('text', '?')} AS question_count,
    {s_count('text', '.')} AS period_count, likes + replies * 2 AS engagement_score,
    ln(1 + likes + replies * 2) AS engagement_log, {s_flags('compound')}, abs(compound) AS sentiment_magnitude,
    {s_any('text', vocab.AI_KEYWORDS)} AS contains_ai, {s_any('text', vocab.OPINION_KEYWORDS)} AS contains_opinion,
    {s_any('text', vocab.SOCIETAL_KEYWORDS_WIDE)} AS contains_societal
  FROM (SELECT *, {s_basic('text')} AS text_clean FROM comments))"""

PREDICTIONS = f"""{LABELLED}, predicted_only AS (
  SELECT doc_id, label AS actual, CASE WHEN doc_id % 5 <> 0 THEN label WHEN label = 'negative' THEN 'neutral'
    WHEN label = 'neutral' THEN 'positive' ELSE 'negative' END AS predicted,
    0.5::DOUBLE + (doc_id % 40) / 100.0::DOUBLE AS p FROM comments),
  preds AS (SELECT doc_id, actual, predicted, {', '.join(
      f"CASE WHEN predicted = '{x}' THEN p ELSE (1 - p) / 2 END AS prob_{x}" for x in LABELS)} FROM predicted_only)"""

_ISO = "strftime(make_timestamp(({}) * 1000000), '%Y-%m-%dT%H:%M:%S')"
_FLAGS = (
    f"{s_any('text', AI_WORDS)} AS contains_ai, {s_any('text', OPINION_WORDS)} AS contains_opinion, "
    f"{s_any('text', SOCIETAL_WORDS)} AS contains_societal"
)

RAW_A = f"""{COMMENTS}, raw_a AS (
  SELECT doc_id AS seq, text, CAST({s_words('text')} AS INTEGER) AS comment_length, compound AS sentiment_polarity,
    doc_id % 10 / 10.0::DOUBLE AS sentiment_positive, doc_id % 8 / 8.0::DOUBLE AS sentiment_negative,
    doc_id % 4 / 4.0::DOUBLE AS sentiment_neutral, doc_id % 5 / 5.0::DOUBLE AS sentiment_subjectivity,
    likes, CAST(replies AS INTEGER) AS num_replies, {_ISO.format('1577836800 + doc_id * 43200')} || '+00:00' AS created_utc,
    'reddit' AS source, 'reddit_comment_' || doc_id AS source_id, 'p' || (doc_id % 97) AS post_id,
    'Post ' || (doc_id % 97) AS post_title, community AS subreddit, (doc_id % 97) * 3 AS post_score,
    (doc_id % 97) / 100.0::DOUBLE AS post_upvote_ratio, doc_id % 97 AS post_num_comments,
    {_ISO.format('1577836800 + doc_id * 43200')} || '+00:00' AS post_created_utc, {_FLAGS}, label AS sentiment_label
  FROM comments)"""

RAW_B = f"""raw_b AS (
  SELECT seq, text, CAST({s_words('text')} AS INTEGER) AS comment_length,
    ((seq * 37) % 201 - 100) / 100.0::DOUBLE AS sentiment_polarity, 0.25::DOUBLE AS sentiment_positive,
    0.25::DOUBLE AS sentiment_negative, 0.5::DOUBLE AS sentiment_neutral, 0.5::DOUBLE AS sentiment_subjectivity,
    seq % 30 AS likes, CAST(seq % 4 AS INTEGER) AS num_replies,
    {_ISO.format('1609459200 + conv_id * 86400 + turn * 60')} || 'Z' AS created_utc, 'youtube' AS source,
    'youtube_comment_' || seq AS source_id, 'v' || conv_id AS video_id, 'Video ' || conv_id AS video_title,
    role AS video_channel, conv_id * 100 AS video_view_count, conv_id * 10 AS video_like_count,
    conv_id AS video_comment_count, {_ISO.format('1609459200 + conv_id * 86400 + turn * 60')} || 'Z' AS video_published_at, {_FLAGS}
  FROM (SELECT *, conv_id * 1000 + turn AS seq FROM conversations))"""


def _unified(raw: str, platform: str, label: str, names: tuple[str, ...], rank: int) -> str:
    post, title, community, score, engagement = names
    return f"""SELECT text, comment_length AS text_length, sentiment_polarity AS sentiment_compound, sentiment_positive,
      sentiment_negative, sentiment_neutral, sentiment_subjectivity, likes, num_replies AS replies, source_id,
      contains_ai, contains_opinion, contains_societal, {post} AS platform_post_id, {title} AS platform_post_title,
      {community} AS platform_community, {score} AS platform_post_score, {engagement} AS platform_post_engagement,
      {label} AS sentiment_label, CAST(replace(left(created_utc, 19), 'T', ' ') AS TIMESTAMP) AS created_at,
      '{platform}' AS source, seq, {rank} AS source_rank FROM {raw}"""


UNIFIED_A = _unified("raw_a", "reddit", "sentiment_label", ("post_id", "post_title", "subreddit", "post_score", "post_num_comments"), 0)
UNIFIED_B = _unified("raw_b", "youtube", s_label("sentiment_polarity"), ("video_id", "video_title", "video_channel", "video_like_count", "video_comment_count"), 1)
MERGED = f"{RAW_A}, {RAW_B}, merged AS ({UNIFIED_A} UNION ALL BY NAME {UNIFIED_B})"
