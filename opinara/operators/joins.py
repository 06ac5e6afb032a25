"""Joins of comments, predictions and labels with their metadata.

No side is broadcast without a check of its size: metadata grows with the data, so those joins are left to the
planner, and adaptive execution splits hot keys of the sort-merge joins. Group sizes are counted first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.operators.sizing import measured


def with_metadata(comments: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Comments whose post or video is known, with its columns. Of repeated metadata the largest row counts."""
    rest = [c for c in metadata.columns if c != key]
    single = metadata.groupBy(key).agg(F.max(F.struct(*rest)).alias("_m")).select(key, *[F.col(f"_m.{c}").alias(c) for c in rest])
    return comments.join(single, key)


def with_group_size(df: DataFrame, key: str, out: str = "community_size") -> DataFrame:
    """Rows of the same key; NULL for a missing key.

    The counts are combined before the shuffle and joined back, instead of a window that would gather a hot
    key in one task. Rows themselves are not shuffled while the groups are few enough to broadcast.
    """
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(out))
    return df.join(measured(sizes), key, "left")


def prediction_text(predictions: DataFrame, originals: DataFrame, key: str, text: str) -> DataFrame:
    """Predictions with the text they were made for, ``N/A`` where it is gone."""
    joined = predictions.join(originals.select(key, F.col(text).alias("text")), key, "left")
    return joined.withColumn("text", F.coalesce("text", F.lit("N/A")))


def side_by_side(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of both tables on one row, matched by key and not by position."""
    return left.join(right, key)


def decode(df: DataFrame, index: str, labels: list[str], out: str) -> DataFrame:
    """Class index to class name."""
    names = F.array(*[F.lit(x) for x in labels])
    return df.withColumn(out, F.get(names, F.col(index).cast("int")))
