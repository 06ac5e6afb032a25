"""Projection and schema operators, unions and keep-first dedup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara import vocab
from opinara.functions import calendar, scores

# --- fixed values: unified column names and the raw column each one takes its value from -------------
UNIFIED_COMMON = {
    "text": "text",
    "text_length": "comment_length",
    "sentiment_compound": "sentiment_polarity",
    "sentiment_positive": "sentiment_positive",
    "sentiment_negative": "sentiment_negative",
    "sentiment_neutral": "sentiment_neutral",
    "sentiment_subjectivity": "sentiment_subjectivity",
    "likes": "likes",
    "replies": "num_replies",
    "source_id": "source_id",
    "contains_ai": "contains_ai",
    "contains_opinion": "contains_opinion",
    "contains_societal": "contains_societal",
}
UNIFIED_BY_PLATFORM = {
    vocab.PLATFORM_A: {
        "platform_post_id": "post_id",
        "platform_post_title": "post_title",
        "platform_community": "subreddit",
        "platform_post_score": "post_score",
        "platform_post_engagement": "post_num_comments",
    },
    vocab.PLATFORM_B: {
        "platform_post_id": "video_id",
        "platform_post_title": "video_title",
        "platform_community": "video_channel",
        "platform_post_score": "video_like_count",
        "platform_post_engagement": "video_comment_count",
    },
}
DASHBOARD_ALIASES = {"sentiment_label": "sentiment", "text_clean": "cleaned_text", "created_at": "timestamp"}


def column_or(df: DataFrame, name: str, default: Column) -> Column:
    """The column when the table has it, else the default expression."""
    return F.col(name) if name in df.columns else default


def harmonise(df: DataFrame, platform: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Bring one raw platform table to the unified schema; ``keep`` passes extra columns through."""
    names = {**UNIFIED_COMMON, **UNIFIED_BY_PLATFORM[platform]}
    return df.select(
        *[F.col(raw).alias(out) for out, raw in names.items()],
        column_or(df, "sentiment_label", scores.sentiment_label("sentiment_polarity")).alias("sentiment_label"),
        calendar.parse_iso("created_utc").alias("created_at"),
        F.lit(platform).alias("source"),
        *keep,
    )


def union_all(*frames: DataFrame, rank_column: str | None = "source_rank") -> DataFrame:
    """Union by name; ``rank_column`` records the position of each input."""
    if rank_column:
        frames = tuple(f.withColumn(rank_column, F.lit(i)) for i, f in enumerate(frames))
    return reduce(lambda a, b: a.unionByName(b), frames)


def row_digest(*columns: str) -> Column:
    """Digest of a row's values at full precision, nulls included; equal digests mean equal rows."""
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
               "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return F.unhex(F.sha2(F.to_json(F.struct(*columns), options), 256))


def keep_first(df: DataFrame, subset: list[str], order_by: list[str]) -> DataFrame:
    """Keep the first row, by ``order_by`` with nulls first, of each set of rows equal on ``subset``.

    Rows that are equal on both are repeats; one of them is kept. The groups are reduced to one narrow row each with
    map-side combining, so a text repeated by a third of all rows costs no more than any other. The kept rows are
    found by an equi-join on two digests, and repeats among them are dropped in the same partitioning.
    """
    order = F.struct(*order_by)
    keyed = df.withColumns({"_digest": row_digest(*subset), "_order": row_digest(*order_by)})
    firsts = keyed.groupBy("_digest").agg(F.min_by("_order", order).alias("_order"))
    return keyed.join(firsts, ["_digest", "_order"], "left_semi").dropDuplicates(["_digest", "_order"]).drop("_digest", "_order")


def alias_if_missing(df: DataFrame, aliases: dict[str, str] = DASHBOARD_ALIASES) -> DataFrame:
    new = {out: F.col(src) for src, out in aliases.items() if src in df.columns and out not in df.columns}
    return df.withColumns(new) if new else df


def finalise_types(df: DataFrame) -> DataFrame:
    """Timestamps, strings for categories, booleans for the content flags."""
    types = {"created_at": "timestamp", "source": "string", "platform_community": "string",
             "sentiment_label": "string", "contains_ai": "boolean", "contains_opinion": "boolean",
             "contains_societal": "boolean"}
    out = {}
    for name, dtype in types.items():
        if name in df.columns:
            current = dict(df.dtypes)[name]
            if dtype == "timestamp" and current == "string":
                out[name] = calendar.parse_iso(name)
            elif current != dtype:
                out[name] = F.col(name).cast(dtype)
    return df.withColumns(out) if out else df


def head(df: DataFrame, columns: list[str], n: int, order_by: list) -> DataFrame:
    return df.orderBy(*order_by).limit(n).select(*columns)


def nth_row(df: DataFrame, n: int, order_by: list) -> DataFrame:
    """The row at position ``n``, counting from zero."""
    return df.orderBy(*order_by).offset(n).limit(1)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def rows_from(df: DataFrame, entries: list[dict[str, Column]]) -> DataFrame:
    """Turn a one-row table into one row per entry, each entry giving the output columns."""
    packed = F.explode(F.array(*[F.struct(*[c.alias(n) for n, c in e.items()]) for e in entries]))
    return df.select(packed.alias("_r")).select("_r.*")


def column_catalogue(df: DataFrame) -> DataFrame:
    """Name, type and non-null count of every column, in one pass."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return rows_from(counts, [
        {"column": F.lit(f.name), "type": F.lit(f.dataType.simpleString()), "non_null": F.col(f.name)}
        for f in df.schema.fields
    ])


def type_histogram(df: DataFrame) -> DataFrame:
    """Columns and present values per type."""
    return column_catalogue(df).groupBy("type").agg(F.count("*").alias("n_columns"), F.sum("non_null").alias("non_null"))


def to_long(df: DataFrame, ids: list[str], values: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def transpose(df: DataFrame, index: str, index_values: list[str], measures: list[str]) -> DataFrame:
    """Rows become columns: one row per measure, one column per value of ``index``."""
    long = to_long(df.select(index, *[F.col(m).cast("double").alias(m) for m in measures]), [index], measures)
    return long.groupBy("metric").pivot(index, index_values).agg(F.first("value"))


def feature_explanation(df: DataFrame, row_id: str, features: dict[str, Column]) -> DataFrame:
    """One row per row and feature: ``(row_id, feature, value)``."""
    named = df.select(row_id, *[c.cast("double").alias(n) for n, c in features.items()])
    return to_long(named, [row_id], list(features), "feature")
