"""Queries for readers, flatteners and writers. Files go to the shared folder and are read back whole."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from opinara import schemas, vocab
from opinara.functions import text
from opinara.plans import experiment, prepare
from opinara.queries import tables as t
from opinara.queries.registry import dates_as_text, query, rounded
from opinara.session import scratch_path
from opinara.sources import flatten, readers, sinks

_RAW_COLUMNS = [
    "text", "comment_length", "sentiment_polarity", "likes", "num_replies", "created_utc", "source_id", "post_id",
    "subreddit", "post_score", "contains_ai", "contains_opinion", "sentiment_label",
]


@query("a01_read_platform_csv", f"WITH {t.RAW_A} SELECT {', '.join(_RAW_COLUMNS)} FROM raw_a")
def a01(spark, sf):
    path = scratch_path(spark, "raw-a-csv")
    sinks.write_csv(t.raw_a(spark, sf).drop("seq"), path)
    return readers.read_platform(spark, path, vocab.PLATFORM_A).select(*_RAW_COLUMNS)


_FINAL_SHOWN = [
    "text", "text_length", "sentiment_compound", "sentiment_label", "likes", "replies", "created_at", "source",
    "source_id", "platform_post_id", "platform_post_title", "platform_community", "platform_post_score",
    "platform_post_engagement", "contains_ai", "contains_opinion", "contains_societal", "text_tfidf", "text_bert",
    "text_clean", "year", "month", "day_of_week", "hour", "word_count", "exclamation_count", "question_count",
    "period_count", "engagement_score", "engagement_log", "is_positive", "is_negative", "is_neutral",
    "sentiment_magnitude", "community_size",
]
_STOP = vocab.STOP_WORDS
_LEMMA = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in t.LEMMAS)
_FINAL_SQL = f"""WITH {t.MERGED},
kept AS (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY text ORDER BY source_rank, seq) = 1),
featured AS (
  SELECT *, coalesce(array_to_string(list_transform({t.s_tokens(t.s_tfidf('text', _STOP))}, lambda w: CASE w {_LEMMA} ELSE w END), ' '), '') AS text_tfidf, {t.s_minimal('text')} AS text_bert, {t.s_basic('text')} AS text_clean,
    CAST(year(created_at) AS INTEGER) AS year, CAST(month(created_at) AS INTEGER) AS month,
    CAST(isodow(created_at) - 1 AS INTEGER) AS day_of_week, CAST(hour(created_at) AS INTEGER) AS hour,
    {t.s_count('text', '!')} AS exclamation_count, {t.s_count('text', '?')} AS question_count, {t.s_count('text', '.')} AS period_count,
    likes + replies * 2 AS engagement_score, round(ln(1 + likes + replies * 2), 6) AS engagement_log,
    {t.s_flags('sentiment_compound')}, abs(sentiment_compound) AS sentiment_magnitude,
    count(platform_community) OVER (PARTITION BY platform_community) AS community_size
  FROM kept)
SELECT * EXCLUDE (created_at, seq, source_rank, sentiment_positive, sentiment_negative, sentiment_neutral, sentiment_subjectivity),
  strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, CAST({t.s_words('text_clean')} AS INTEGER) AS word_count
FROM featured WHERE length(text_clean) > 0"""


def _final(spark, sf):
    return prepare.prepare(t.raw_a(spark, sf), t.raw_b(spark, sf), "seq", lemma_table=t.lemma_table(spark))


@query("a00_final_table", _FINAL_SQL)
def a00(spark, sf):
    """The whole preparation: harmonise, union, dedupe, clean, engineer, drop empty."""
    return rounded(dates_as_text(_final(spark, sf).select(*_FINAL_SHOWN)))


@query("a02_typed_load", _FINAL_SQL)
def a02(spark, sf):
    path = scratch_path(spark, "final-csv")
    sinks.write_csv(_final(spark, sf).select(*schemas.FINAL_COLUMNS), path)
    return rounded(dates_as_text(readers.read_final(spark, path).select(*_FINAL_SHOWN)))


@query("a03_dashboard_load", f"""WITH {t.COMMENTS} SELECT doc_id, sentiment, date, year, month, month_name,
  CAST(length(cleaned_text) AS INTEGER) AS text_length, CAST({t.s_words('cleaned_text')} AS INTEGER) AS word_count,
  round({t.s_average('cleaned_text')}, 6) AS avg_word_length, {t.s_hits('cleaned_text')} AS ai_keyword_count,
  {t.s_count('cleaned_text', '!')} AS exclamation_count, {t.s_count('cleaned_text', '?')} AS question_count,
  contains(cleaned_text, '?') AS has_question, contains(cleaned_text, '!') AS has_exclamation
  FROM (SELECT doc_id, label AS sentiment, {t.s_basic('text')} AS cleaned_text, strftime(ts, '%Y-%m-%d') AS date,
    CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, monthname(ts) AS month_name
    FROM (SELECT *, make_timestamp((1577836800 + doc_id * 43200) * 1000000) AS ts FROM comments))""")
def a03(spark, sf):
    path = scratch_path(spark, "dashboard")
    stored = t.comments(spark, sf).select(
        "doc_id", F.col("label").alias("sentiment_label"), text.clean_basic("text").alias("text_clean"),
        F.timestamp_seconds(F.lit(1577836800) + F.col("doc_id") * 43200).alias("created_at"),
    )
    sinks.write_table(stored, path, ())
    view = readers.load_dashboard(spark, path, "parquet")
    return rounded(dates_as_text(view.select(
        "doc_id", "sentiment", "date", "year", "month", "month_name", "text_length", "word_count", "avg_word_length",
        "ai_keyword_count", "exclamation_count", "question_count", "has_question", "has_exclamation",
    )))


@query("a04_records_to_table", f"WITH {t.RAW_A} SELECT {', '.join(_RAW_COLUMNS)} FROM raw_a")
def a04(spark, sf):
    path = scratch_path(spark, "records")
    t.raw_a(spark, sf).drop("seq").write.json(path)
    return readers.read_records(spark, path).select(*_RAW_COLUMNS)


def _thread_dump(spark, sf):
    """Conversations as nested responses; the first turn lacks counts and every turn lacks an id."""
    missing = F.col("turn") == 0
    item = F.struct(F.struct(
        F.struct(F.struct(
            F.col("text").alias("textDisplay"),
            F.when(~missing, F.col("turn") * 3).alias("likeCount"),
            F.lit("2024-01-01T00:00:00Z").alias("publishedAt"),
        ).alias("snippet")).alias("topLevelComment"),
        F.when(~missing, F.col("turn").cast("int")).alias("totalReplyCount"),
    ).alias("snippet"))
    turns = t.table(spark, sf, "conversations").select(F.concat(F.lit("v"), "conv_id").alias("video_id"), F.struct("turn", item.alias("item")).alias("x"))
    return turns.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["item"]).alias("items"))


@query("a05_flatten_threads", f"""SELECT 'v' || conv_id AS video_id, CAST(turn AS INTEGER) AS position, trim(text) AS raw_text,
  turn * 3 AS likes, CAST(turn AS INTEGER) AS num_replies, '2024-01-01T00:00:00Z' AS created_utc,
  'youtube_comment_None' AS source_id, 'youtube' AS source FROM conversations""")
def a05(spark, sf):
    path = scratch_path(spark, "threads")
    _thread_dump(spark, sf).write.json(path)
    return flatten.flatten_threads(spark.read.schema(schemas.THREADS).json(path))


@query("a05_flatten_videos", """SELECT 'v' || c_custkey AS video_id, c_name AS video_title, '' AS video_description,
  '2024-01-01T00:00:00Z' AS video_published_at, c_mktsegment AS video_channel, c_custkey AS video_view_count,
  CAST(c_nationkey AS BIGINT) AS video_like_count, 0 AS video_comment_count FROM customer""")
def a05_videos(spark, sf):
    item = F.struct(
        F.concat(F.lit("v"), "c_custkey").alias("id"),
        F.struct(F.col("c_name").alias("title"), F.lit("2024-01-01T00:00:00Z").alias("publishedAt"), F.col("c_mktsegment").alias("channelTitle")).alias("snippet"),
        F.struct(F.col("c_custkey").cast("string").alias("viewCount"), F.col("c_nationkey").cast("string").alias("likeCount")).alias("statistics"),
    )
    path = scratch_path(spark, "videos")
    t.table(spark, sf, "customer").select(F.array(item).alias("items")).write.json(path)
    return flatten.flatten_videos(spark.read.schema(schemas.VIDEOS).json(path)).drop("video_published_date")


def _post_dump(spark, sf):
    """Conversations as posts: turn 0 answers the post, the other turns answer turn 0."""
    c = t.table(spark, sf, "conversations")
    node = F.struct(
        F.concat_ws("_", "conv_id", "turn").alias("id"), F.col("text").alias("body"), F.col("turn").alias("score"),
        (F.lit(1577836800) + F.col("conv_id") * 86400).cast("double").alias("created_utc"),
    )
    children = c.where("turn > 0").groupBy("conv_id").agg(F.array_sort(F.collect_list(node)).alias("kids"))
    roots = c.where("turn = 0").select("conv_id", node.alias("root")).join(children, "conv_id", "left")
    tree = F.array(F.struct("root.*", F.coalesce("kids", F.array()).alias("replies")))
    return roots.select(
        F.concat(F.lit("p"), "conv_id").alias("id"), F.concat(F.lit("Title "), "conv_id").alias("title"),
        F.lit("general").alias("subreddit"), tree.alias("comments"),
    )


@query("a06_flatten_comment_trees", """SELECT 'p' || conv_id AS post_id, CASE WHEN turn = 0 THEN 0 ELSE 1 END AS depth, text, turn AS likes,
  CASE WHEN turn = 0 THEN n - 1 ELSE 0 END AS num_replies,
  strftime(make_timestamp((1577836800 + conv_id * 86400) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS created_utc,
  'reddit_comment_' || conv_id || '_' || turn AS source_id, 'reddit' AS source
  FROM (SELECT *, CAST(count(*) OVER (PARTITION BY conv_id) AS INTEGER) AS n, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations)
  WHERE first = 0 AND text NOT IN ('', '[deleted]', '[removed]')""")
def a06(spark, sf):
    path = scratch_path(spark, "posts")
    _post_dump(spark, sf).write.json(path)
    return flatten.flatten_comment_trees(spark.read.schema(schemas.POSTS).json(path))


@query("a07_write_partitioned", f"WITH {t.COMMENTS} SELECT doc_id, text, source, CAST(year(make_timestamp((1577836800 + doc_id * 43200) * 1000000)) AS INTEGER) AS year FROM comments")
def a07(spark, sf):
    path = scratch_path(spark, "partitioned")
    rows = t.comments(spark, sf).select("doc_id", "text", "source", F.year(F.timestamp_seconds(F.lit(1577836800) + F.col("doc_id") * 43200)).alias("year"))
    sinks.write_table(rows, path)
    return spark.read.schema("doc_id bigint, text string, source string, year int").parquet(path)


@query("a07_write_csv", f"WITH {t.COMMENTS} SELECT doc_id, text, source, likes FROM comments")
def a07_csv(spark, sf):
    path = scratch_path(spark, "csv")
    sinks.write_csv(t.comments(spark, sf).select("doc_id", "text", "source", "likes"), path)
    return readers.read_csv(spark, path, "doc_id bigint, text string, source string, likes bigint")


@query("a08_export_predictions", f"WITH {t.PREDICTIONS} SELECT doc_id, actual, predicted, {', '.join(f'round(prob_{x}, 6) AS prob_{x}' for x in t.LABELS)} FROM preds")
def a08(spark, sf):
    path = scratch_path(spark, "predictions")
    sinks.export_predictions(t.predictions(spark, sf), "doc_id", t.LABELS, path)
    shape = "doc_id bigint, actual string, predicted string, " + ", ".join(f"prob_{x} double" for x in t.LABELS)
    return rounded(readers.read_csv(spark, path, shape))


@query("a09_parameters_json", """SELECT 'n' || n_nationkey AS run, '{"C":"' || n_regionkey || '","name":"' || n_name || '"}' AS json FROM nation""")
def a09(spark, sf):
    n = t.table(spark, sf, "nation")
    run = F.concat(F.lit("n"), "n_nationkey").alias("run")
    params = n.select(run, F.lit("C").alias("parameter"), F.col("n_regionkey").cast("string").alias("value")).unionByName(
        n.select(run, F.lit("name").alias("parameter"), F.col("n_name").alias("value")))
    return sinks.parameters_json(params)


@query("a10_save_and_reload_model", f"WITH {t.LABELLED} SELECT doc_id, label, 1.0::DOUBLE AS total, true AS same FROM comments")
def a10(spark, sf):
    """Every text scored by a pipeline that was saved and loaded again, beside the one in memory."""
    c = t.labelled(spark, sf)
    outcome = experiment.run(c, "doc_id", "text", "label", t.LABELS)
    path = scratch_path(spark, "model")
    pipeline = experiment.text_pipeline(outcome)
    sinks.save_model(pipeline, path)
    names = [f"prob_{x}" for x in t.LABELS]
    saved = experiment.score_texts(sinks.load_model(path), c, ["doc_id", "label"], t.LABELS)
    here = experiment.score_texts(pipeline, c, ["doc_id"], t.LABELS).select("doc_id", *[F.col(n).alias(f"_{n}") for n in names])
    same = reduce(and_, [F.abs(F.col(n) - F.col(f"_{n}")) < 1e-9 for n in names])
    return saved.join(here, "doc_id").select("doc_id", "label", F.round(sum(F.col(n) for n in names), 6).alias("total"), same.alias("same"))
