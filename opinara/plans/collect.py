"""From raw dumps to scored and labelled platform tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara import vocab
from opinara.functions import calendar, keywords, scores, text
from opinara.operators import joins, limits, polarity, relevance
from opinara.operators.sizing import measured
from opinara.sources import flatten


def relevant_posts(
    posts: DataFrame, lexicon: DataFrame, search: list[list[str]] | None = None, post_limit: int | None = None,
    lists: dict | None = None, rules: dict | None = None,
) -> DataFrame:
    """Posts that a search finds and the relevance rule keeps.

    ``search`` holds groups of terms of which each needs one in title or body; of what is found, the newest
    ``post_limit`` of a community are looked at. Cheap filters run first, polarity only on what they leave.
    """
    if search:
        posts = posts.where(keywords.matches_search(["title", "selftext"], search))
    if post_limit:
        posts = limits.cap_per_group(posts, ["community_rank"], [F.desc("created_utc"), F.col("id")], post_limit)
    body = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("selftext", F.lit("")))
    candidates = posts.where(
        relevance.in_date_range(calendar.from_epoch("created_utc"))
        & F.col("is_self") & (F.col("num_comments") >= vocab.MIN_POST_COMMENTS)
        & relevance.post_prefilter(body, **(lists or {}))
    ).withColumn("full_text", body)
    scored = polarity.polarity(candidates, "id", "full_text", lexicon, **(rules or {})).select("id", "compound")
    return candidates.join(scored, "id").where(
        scores.subjectivity("full_text", "compound") >= vocab.MIN_SUBJECTIVITY_POST
    )


def collect_platform_a(
    posts: DataFrame, lexicon: DataFrame, target: int = vocab.TARGET_COMMENTS,
    search: list[list[str]] | None = None, post_limit: int | None = None, lists: dict | None = None, rules: dict | None = None,
) -> DataFrame:
    """Relevant posts in order, newest first within a community, until enough comments are collected.

    ``posts`` has a ``community_rank`` for the order in which communities are visited: one at first, then twice as many
    in each round, until the running total of comments reaches the target. Later communities are not looked at, and the
    rows are those of a single cut through all of them. ``lists`` are the keyword lists of the relevance rules, ``rules``
    those of the polarity.
    """
    lists = lists or {}
    last = posts.agg(F.max("community_rank")).first()[0]
    low, width, total, rounds = 0 if last is None else posts.agg(F.min("community_rank")).first()[0], 1, 0, []
    while not rounds or (low <= last and total < target):
        visited = posts.where(F.col("community_rank").between(low, low + width - 1))
        relevant = measured(relevant_posts(visited, lexicon, search, post_limit, lists, rules), "posts")
        comments = flatten.flatten_comment_trees(relevant).where(relevance.relevant_comment_a(F.col("text"), **lists))
        ordered = comments.groupBy("post_id").agg(F.count("*").alias("n_comments")).join(
            relevant.select(F.col("id").alias("post_id"), F.struct("community_rank", -F.col("created_utc"), "id").alias("visit")), "post_id")
        rounds.append((comments, measured(ordered, "visits"), flatten.post_metadata(relevant)))
        total += rounds[-1][1].agg(F.coalesce(F.sum("n_comments"), F.lit(0))).first()[0]
        low, width = low + width, 2 * width
        if last is None:
            break

    comments, ordered, metadata = (reduce(DataFrame.unionByName, parts) for parts in zip(*rounds))
    wanted = limits.cap_cumulative(ordered, "visit", "n_comments", target).select("post_id")
    kept = comments.join(wanted, "post_id").join(metadata, "post_id")
    named = {k: v for k, v in lists.items() if k in ("opinion", "societal")}
    flags = keywords.content_flags("text", keywords.contains_any("text", lists.get("ai", vocab.AI_KEYWORDS)),
                                   **{"societal": vocab.SOCIETAL_KEYWORDS_WIDE, **named})
    return polarity.with_scores(kept, "source_id", "text", lexicon, **(rules or {})).withColumns(
        {"comment_length": text.word_count("text"), **flags}
    )


def collect_platform_b(
    threads: DataFrame, videos: DataFrame, lexicon: DataFrame,
    videos_per_query: int = vocab.VIDEOS_PER_QUERY, comments_per_video: int = vocab.COMMENTS_PER_VIDEO,
    lists: dict | None = None, rules: dict | None = None,
) -> DataFrame:
    """Relevant comments of the first videos of each query that have some.

    ``threads`` is flattened and carries a unique ``comment_id``; ``videos`` carries ``query`` and ``position``
    in the search result. Only a video that yields comments takes up a place of its query. ``lists`` are the keyword
    lists of the relevance rule, ``rules`` those of the polarity.
    """
    lists = lists or {}
    eligible = videos.where(relevance.engaged_video("video_comment_count"))
    cleaned = joins.with_metadata(threads, eligible.select("video_id").distinct(), "video_id").withColumn(
        "text", text.clean_platform_b("raw_text")
    )
    likely = measured(cleaned.where(relevance.comment_b_prefilter("text", **lists)), "comments")
    scored = polarity.with_scores(likely, "comment_id", "text", lexicon, **(rules or {})).where(
        F.col("sentiment_subjectivity") >= vocab.MIN_SUBJECTIVITY_COMMENT
    )
    capped = measured(limits.cap_per_group(scored, ["video_id"], ["position"], comments_per_video), "capped")
    yielding = eligible.join(capped.select("video_id").distinct(), "video_id", "left_semi")
    chosen = limits.cap_per_group(yielding, ["query"], ["position"], videos_per_query).drop("position")
    named = {k: v for k, v in lists.items() if k in ("opinion", "societal")}
    ai = lists.get("ai", (vocab.AI_WHOLE_WORDS, vocab.AI_PHRASES))
    flags = keywords.content_flags("text", keywords.mentions_ai("text", *ai), **{"societal": vocab.SOCIETAL_KEYWORDS, **named})
    return joins.with_metadata(capped, chosen, "video_id").withColumns(
        {"comment_length": text.word_count("text"), **flags}
    )
