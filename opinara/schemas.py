"""Explicit schemas of every table that is read, as DDL text."""

_SCORED = (
    "text string, comment_length int, sentiment_polarity double, sentiment_positive double, "
    "sentiment_negative double, sentiment_neutral double, sentiment_subjectivity double, likes bigint, "
    "num_replies int, created_utc string, source string, source_id string, "
)
_FLAGS = "contains_ai boolean, contains_opinion boolean, contains_societal boolean, sentiment_label string"

RAW_A = (
    _SCORED + "post_id string, post_title string, subreddit string, post_score bigint, post_upvote_ratio double, "
    "post_num_comments bigint, post_created_utc string, " + _FLAGS
)
RAW_B = (
    _SCORED + "video_id string, video_title string, video_channel string, video_view_count bigint, "
    "video_like_count bigint, video_comment_count bigint, video_published_at string, " + _FLAGS
)
FINAL = (
    "text string, text_length int, sentiment_compound double, sentiment_positive double, "
    "sentiment_negative double, sentiment_neutral double, sentiment_subjectivity double, sentiment_label string, "
    "likes bigint, replies int, created_at string, source string, source_id string, platform_post_id string, "
    "platform_post_title string, platform_community string, platform_post_score bigint, "
    "platform_post_engagement bigint, contains_ai boolean, contains_opinion boolean, contains_societal boolean, "
    "text_tfidf string, text_bert string, text_clean string, year int, month int, day_of_week int, hour int, "
    "word_count int, exclamation_count int, question_count int, period_count int, engagement_score bigint, "
    "engagement_log double, is_positive int, is_negative int, is_neutral int, sentiment_magnitude double, "
    "community_size bigint"
)
THREADS = (
    "video_id string, items array<struct<snippet: struct<topLevelComment: struct<snippet: struct<"
    "textDisplay: string, likeCount: bigint, publishedAt: string, id: string>>, totalReplyCount: int>>>"
)
VIDEOS = (
    "items array<struct<id: string, snippet: struct<title: string, description: string, publishedAt: string, "
    "channelTitle: string>, statistics: struct<viewCount: string, likeCount: string, commentCount: string>>>"
)
# Comments stay JSON text, so trees of any depth fit one schema.
POSTS = (
    "id string, title string, selftext string, subreddit string, score bigint, upvote_ratio double, "
    "num_comments bigint, created_utc double, is_self boolean, comments string"
)
RECORDS = RAW_A
FINAL_COLUMNS = [column.split()[0] for column in FINAL.split(", ")]
