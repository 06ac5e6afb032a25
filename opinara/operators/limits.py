"""Top-k, caps per group, cumulative caps, repeatable samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinara.operators.prefix import with_prefix_sums


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values, ties by value, with their rank."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    best = counts.orderBy(F.desc("n"), column).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), column)))


def cap_per_group(df: DataFrame, keys: list[str], order_by: list[Column | str], k: int) -> DataFrame:
    """At most k rows per group. Each task keeps its own first k before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order_by))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def ranked_per_group(df: DataFrame, keys: list[str], order_by: list[Column | str], k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order_by))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def cap_cumulative(df: DataFrame, order_by: str, amount: str, target: float) -> DataFrame:
    """Rows in order until the amounts reach the target; the row that crosses it is kept.

    Amounts may be fractions. Rows without a positive amount are left out. ``order_by`` must be unique. The running
    sum is taken over ranges of the order with offsets, so no task sees more than one range.
    """
    positive = df.where(F.col(amount) > 0)
    summed = with_prefix_sums(positive, [], order_by, [amount]).drop(f"{amount}_total")
    return summed.withColumnRenamed(f"{amount}_before", "collected_before").where(F.col("collected_before") < target)


def hash_key(row_id: str, seed: int) -> Column:
    """Repeatable pseudo-random order of rows with a unique id."""
    return F.md5(F.concat_ws(":", F.col(row_id).cast("string"), F.lit(str(seed))))


def sample_rows(df: DataFrame, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same ones for the same seed however the table is partitioned."""
    return df.orderBy(hash_key(row_id, seed)).limit(n)


def newest(df: DataFrame, ts: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(ts), tie).limit(n)
