"""Nested API responses to flat tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara import vocab
from opinara.functions import calendar
from opinara.operators.relevance import present_body
from opinara.operators.sizing import measured


def flatten_threads(threads: DataFrame) -> DataFrame:
    """Platform B threads ``(video_id, items)``: one row per top comment, defaults for missing keys."""
    item = threads.select("video_id", F.posexplode("items").alias("position", "item"))
    snippet = F.col("item.snippet.topLevelComment.snippet")
    return item.select(
        "video_id", "position",
        F.trim(F.coalesce(snippet["textDisplay"], F.lit(""))).alias("raw_text"),
        F.coalesce(snippet["likeCount"], F.lit(0)).alias("likes"),
        F.coalesce(F.col("item.snippet.totalReplyCount"), F.lit(0)).alias("num_replies"),
        snippet["publishedAt"].alias("created_utc"),
        F.concat(F.lit("youtube_comment_"), F.coalesce(snippet["id"], F.lit("None"))).alias("source_id"),
        F.lit(vocab.PLATFORM_B).alias("source"),
    )


def flatten_videos(responses: DataFrame) -> DataFrame:
    """Platform B video responses: one row per video, counts as numbers, defaults for missing keys."""
    item = responses.select(F.explode("items").alias("item"))
    snippet, stats = F.col("item.snippet"), F.col("item.statistics")

    def number(name: str):
        return F.coalesce(stats[name].cast("bigint"), F.lit(0))

    def words(name: str):
        return F.coalesce(snippet[name], F.lit(""))

    return item.select(
        F.col("item.id").alias("video_id"),
        words("title").alias("video_title"), words("description").alias("video_description"),
        words("publishedAt").alias("video_published_at"),
        calendar.parse_iso(snippet["publishedAt"]).alias("video_published_date"),
        words("channelTitle").alias("video_channel"),
        number("viewCount").alias("video_view_count"), number("likeCount").alias("video_like_count"),
        number("commentCount").alias("video_comment_count"),
    )


def post_metadata(posts: DataFrame) -> DataFrame:
    return posts.select(
        F.col("id").alias("post_id"), F.col("title").alias("post_title"), "subreddit",
        F.col("score").alias("post_score"), F.col("upvote_ratio").alias("post_upvote_ratio"),
        F.col("num_comments").alias("post_num_comments"),
        calendar.iso_text(calendar.from_epoch("created_utc")).alias("post_created_utc"),
    )


#: Levels of replies unfolded in one pass over the rows.
LEVELS = 64


def unfolded(branches: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(post_id, first, comments, rest): the comments of so many levels of each tree, and the branches below them.

    A branch is an array of parsed comments. The tree is walked inside the row, level by level, on its parsed form.
    """
    branch = "array<variant>"
    comment = "struct<level:int,id:string,body:string,score:bigint,created_utc:double,num_replies:int>"

    def replies(c):
        return F.try_variant_get(c, "$.replies", branch)

    def fields(c, level):
        def take(name, kind):
            return F.try_variant_get(c, f"$.{name}", kind).alias(name)

        return F.struct(level.cast("int").alias("level"), take("id", "string"), take("body", "string"), take("score", "bigint"),
                        take("created_utc", "double"), F.coalesce(F.size(replies(c)), F.lit(0)).alias("num_replies"))

    def down(state, level):
        here = state["rest"]
        below = F.flatten(F.filter(F.transform(here, replies), lambda r: r.isNotNull()))
        return F.struct(F.concat(state["comments"], F.transform(here, lambda c: fields(c, level))).alias("comments"), below.alias("rest"))

    start = F.struct(F.array().cast(f"array<{comment}>").alias("comments"), F.col("branch").alias("rest"))
    walked = F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), start, down)
    return branches.select("post_id", "first", walked.alias("_w")).select("post_id", "first", "_w.comments", "_w.rest")


def flatten_comment_trees(posts: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Platform A comment trees of any depth: one row per comment with its direct reply count.

    A tree is parsed once and unfolded in its row. Only where one is deeper than ``levels``, what lies below is
    written and unfolded in the same way, so depth costs a job per ``levels`` levels and never a second parse.
    """
    parsed = F.try_variant_get(F.try_parse_json("comments"), "$", "array<variant>")
    branches = posts.select(F.col("id").alias("post_id"), F.lit(0).alias("first"), F.coalesce(parsed, F.array().cast("array<variant>")).alias("branch"))
    found = []
    while True:
        walked = measured(unfolded(branches, levels), "trees")
        found.append(walked.select("post_id", "first", F.explode("comments").alias("c")))
        rest = walked.where(F.size("rest") > 0)
        if rest.isEmpty():
            break
        branches = rest.select("post_id", (F.col("first") + levels).alias("first"), F.col("rest").alias("branch"))
    rows = reduce(lambda a, b: a.unionByName(b), found)
    return rows.where(present_body("c.body")).select(
        "post_id", (F.col("first") + F.col("c.level")).alias("depth"), F.col("c.body").alias("text"), F.col("c.score").alias("likes"),
        F.col("c.num_replies").alias("num_replies"),
        calendar.iso_text(calendar.from_epoch("c.created_utc")).alias("created_utc"),
        F.concat(F.lit("reddit_comment_"), "c.id").alias("source_id"),
        F.lit(vocab.PLATFORM_A).alias("source"),
    )
