"""The two collection flows, on dumps derived from the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara import schemas, vocab
from opinara.plans import collect
from opinara.queries import tables as t
from opinara.queries.polarity import RULES, scores_sql
from opinara.queries.registry import query, rounded
from opinara.session import scratch_path

_LISTS = {"ai": t.AI_WORDS, "opinion": t.OPINION_WORDS, "societal": t.SOCIETAL_WORDS}
_SEARCH = [["the", "der", "la", "de"], ["que", "and", "of", "und"]]
_POST_LIMIT, _TARGET = 8, 5
_PER_VIDEO, _PER_QUERY = 2, 3


def _topical(c: str) -> str:
    return f"{t.s_any(c, t.AI_WORDS)} AND ({t.s_any(c, t.OPINION_WORDS)} OR {t.s_any(c, t.SOCIETAL_WORDS)})"


def _post_dump(spark, sf):
    """A conversation as a post: turn 0 is its title, turns 1 and 2 answer it, and all later ones answer turn 1."""
    c = t.table(spark, sf, "conversations")
    conv = F.col("conv_id")
    node = F.struct(
        F.concat_ws("_", "conv_id", "turn").alias("id"), F.col("text").alias("body"), F.col("turn").alias("score"),
        (F.lit(1577836800) + conv * 86400 + F.col("turn")).cast("double").alias("created_utc"),
    )
    parts = c.groupBy("conv_id").agg(
        F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("title"),
        F.max(F.when(F.col("turn") == 1, node)).alias("first"), F.max(F.when(F.col("turn") == 2, node)).alias("second"),
        F.array_sort(F.collect_list(F.when(F.col("turn") > 2, node))).alias("kids"),
    )
    first = F.when(F.col("first").isNotNull(), F.array(F.struct("first.*", F.col("kids").alias("replies")))).otherwise(F.array())
    second = F.when(F.col("second").isNotNull(), F.array(F.struct("second.*", F.slice("kids", 1, 0).alias("replies")))).otherwise(F.array())
    return parts.select(
        F.concat(F.lit("p"), conv).alias("id"), "title", F.when(conv % 2 == 0, F.lit("no body")).alias("selftext"),
        F.concat(F.lit("s"), conv % 10).alias("subreddit"), conv.alias("score"), (conv % 100 / F.lit(100.0)).alias("upvote_ratio"),
        (conv % 9 + 2).alias("num_comments"), (F.lit(1577836800) + conv * 86400).cast("double").alias("created_utc"),
        (conv % 11 != 0).alias("is_self"), F.concat(first, second).alias("comments"), (conv % 10).cast("int").alias("community_rank"),
    )


_ALL_A = """(SELECT 'p' || conv_id AS doc_id, coalesce(text, '') || ' ' || CASE WHEN conv_id % 2 = 0 THEN 'no body' ELSE '' END AS text FROM conversations WHERE turn = 0
  UNION ALL SELECT conv_id || '_' || turn, text FROM conversations WHERE turn > 0)"""


@query("collect_a", f"""{scores_sql(_ALL_A)},
found AS (
  SELECT 'p' || conv_id AS id, conv_id % 10 AS rank, conv_id, conv_id % 9 + 2 AS num_comments, conv_id % 11 <> 0 AS is_self,
    concat_ws(' ', text, CASE WHEN conv_id % 2 = 0 THEN 'no body' END) AS searched
  FROM conversations WHERE turn = 0 AND {' AND '.join(t.s_any("concat_ws(' ', text, CASE WHEN conv_id % 2 = 0 THEN 'no body' END)", g) for g in _SEARCH)}
  QUALIFY row_number() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id DESC, 'p' || conv_id) <= {_POST_LIMIT}
), posts AS (
  SELECT found.*, s.text AS full_text FROM found JOIN scored s ON s.doc_id = found.id
  WHERE conv_id <= 2191 AND is_self AND num_comments >= {vocab.MIN_POST_COMMENTS} AND {t.s_words('s.text')} BETWEEN 10 AND 1500 AND {_topical('s.text')}
    AND {t.s_subjectivity('s.text', 's.compound')} >= 0.3
), comments AS (
  SELECT p.id AS post_id, p.rank, p.conv_id, c.turn, c.text,
    CAST(CASE WHEN c.turn = 1 THEN (SELECT count(*) FROM conversations k WHERE k.conv_id = c.conv_id AND k.turn > 2) ELSE 0 END AS INTEGER) AS num_replies
  FROM posts p JOIN conversations c ON c.conv_id = p.conv_id
  WHERE c.turn > 0 AND c.text NOT IN ('', '[deleted]', '[removed]') AND {t.s_words('c.text')} BETWEEN 10 AND 300 AND {_topical('c.text')}
), visits AS (SELECT post_id, rank, conv_id, count(*) AS n FROM comments GROUP BY ALL),
wanted AS (
  SELECT post_id FROM (SELECT post_id, coalesce(sum(n) OVER (ORDER BY rank, conv_id DESC, post_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM visits)
  WHERE before < {_TARGET}
)
SELECT c.post_id, 's' || rank AS subreddit, CASE WHEN turn <= 2 THEN 0 ELSE 1 END AS depth, 'reddit_comment_' || conv_id || '_' || turn AS source_id, num_replies, turn AS likes,
  CAST({t.s_words('c.text')} AS INTEGER) AS comment_length, s.compound AS sentiment_polarity, {t.s_label('s.compound')} AS sentiment_label,
  {t.s_any('c.text', t.AI_WORDS)} AS contains_ai, {t.s_any('c.text', t.OPINION_WORDS)} AS contains_opinion, {t.s_any('c.text', t.SOCIETAL_WORDS)} AS contains_societal
FROM comments c JOIN wanted USING (post_id) JOIN scored s ON s.doc_id = conv_id || '_' || turn""")
def collect_a(spark, sf):
    """Platform A: search, newest posts of a community, relevance, comment trees, and the stop at a running total."""
    path = scratch_path(spark, "posts")
    _post_dump(spark, sf).write.json(path)
    posts = spark.read.schema(schemas.POSTS + ", community_rank int").json(path)
    out = collect.collect_platform_a(posts, t.lexicon(spark), _TARGET, search=_SEARCH, post_limit=_POST_LIMIT, lists=_LISTS, rules=RULES)
    return rounded(out.select(
        "post_id", "subreddit", "depth", "source_id", "num_replies", "likes", "comment_length", "sentiment_polarity", "sentiment_label",
        "contains_ai", "contains_opinion", "contains_societal"))


_CLEAN_B = f"(SELECT 'c' || conv_id || '_' || turn AS doc_id, {t.s_platform_b('trim(text)')} AS text FROM conversations)"


@query("collect_b", f"""{scores_sql(_CLEAN_B)},
eligible AS (SELECT conv_id, 'v' || conv_id AS video_id, 'q' || (conv_id % 12) AS query, conv_id % 25 AS n FROM conversations WHERE turn = 0 AND conv_id % 25 >= {vocab.MIN_VIDEO_COMMENTS}),
capped AS (
  SELECT c.conv_id, c.turn, e.video_id, s.text, s.compound FROM conversations c JOIN eligible e ON e.conv_id = c.conv_id
  JOIN scored s ON s.doc_id = 'c' || c.conv_id || '_' || c.turn WHERE {t.s_relevant_b('s.text', 's.compound')}
  QUALIFY row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) <= {_PER_VIDEO}
), chosen AS (
  SELECT * FROM eligible WHERE video_id IN (SELECT video_id FROM capped) QUALIFY row_number() OVER (PARTITION BY query ORDER BY conv_id) <= {_PER_QUERY}
)
SELECT 'c' || conv_id || '_' || turn AS comment_id, video_id, query, n AS video_comment_count, text, CAST({t.s_words('text')} AS INTEGER) AS comment_length,
  compound AS sentiment_polarity, {t.s_label('compound')} AS sentiment_label,
  ({t.s_word('text', t.RULE_B['ai'][0])} OR {t.s_any('text', t.RULE_B['ai'][1])}) AS contains_ai,
  {t.s_any('text', t.OPINION_WORDS)} AS contains_opinion, {t.s_any('text', t.SOCIETAL_WORDS)} AS contains_societal
FROM capped JOIN chosen USING (conv_id, video_id)""")
def collect_b(spark, sf):
    """Platform B: relevant comments of the first videos of each query that yield any."""
    c = t.table(spark, sf, "conversations")
    conv = F.col("conv_id")
    threads = c.select(
        F.concat(F.lit("c"), F.concat_ws("_", "conv_id", "turn")).alias("comment_id"), F.concat(F.lit("v"), conv).alias("video_id"),
        F.col("turn").alias("position"), F.trim("text").alias("raw_text"))
    videos = c.where("turn = 0").select(
        F.concat(F.lit("q"), conv % 12).alias("query"), F.concat(F.lit("v"), conv).alias("video_id"), conv.alias("position"),
        (conv % 25).alias("video_comment_count"))
    out = collect.collect_platform_b(threads, videos, t.lexicon(spark), _PER_QUERY, _PER_VIDEO, lists=t.RULE_B, rules=RULES)
    return rounded(out.select(
        "comment_id", "video_id", "query", "video_comment_count", "text", "comment_length", "sentiment_polarity", "sentiment_label",
        "contains_ai", "contains_opinion", "contains_societal"))
