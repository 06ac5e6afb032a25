"""Time series: yearly counts and months with gaps filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.scores import share


def yearly_counts(df: DataFrame, ts: str, by: list[str] | None = None) -> DataFrame:
    year = F.year(ts).alias("year")
    return df.where(F.col(ts).isNotNull()).groupBy(year, *(by or [])).agg(F.count("*").alias("n")).orderBy("year", *(by or []))


def monthly(df: DataFrame, ts: str, measures: dict[str, Column]) -> DataFrame:
    """One row per month end between the first and the last month, with empty months kept.

    Rows are reduced to months first; the calendar and the join see months only. ``n`` is 0 in an empty
    month, other measures are NULL.
    """
    month = F.trunc(F.to_date(ts), "month")
    per_month = df.where(F.col(ts).isNotNull()).groupBy(month.alias("_month")).agg(
        F.count("*").alias("n"), *[c.alias(k) for k, c in measures.items()]
    )
    months = per_month.agg(F.min("_month").alias("_from"), F.max("_month").alias("_to")).select(
        F.explode(F.sequence("_from", "_to", F.expr("interval 1 month"))).alias("_month")
    )
    filled = months.join(per_month, "_month", "left")
    return filled.select(F.last_day("_month").alias("month_end"), F.coalesce("n", F.lit(0)).alias("n"), *measures).orderBy("month_end")


def monthly_volume(df: DataFrame, ts: str) -> DataFrame:
    return monthly(df, ts, {})


def monthly_mean(df: DataFrame, ts: str, value: str) -> DataFrame:
    return monthly(df, ts, {"mean": F.avg(value)})


def monthly_shares(df: DataFrame, ts: str, flags: dict[str, str]) -> DataFrame:
    """Percentage of rows with each 0/1 flag set, per month."""
    return monthly(df, ts, {out: share(F.sum(flag), F.count("*")) for out, flag in flags.items()})


def trend(df: DataFrame, period: str, value: str) -> DataFrame:
    """First and last period mean, their difference, direction, best and worst period.

    No row when there is a single period.
    """
    means = df.where(F.col(period).isNotNull()).groupBy(period).agg(F.avg(value).alias("mean"))
    low_first = F.struct(F.col("mean"), F.col(period))
    high_first = F.struct(F.col("mean"), -F.col(period))
    ends = means.agg(
        F.count("*").alias("_periods"),
        F.min_by("mean", period).alias("first_mean"), F.max_by("mean", period).alias("last_mean"),
        F.max_by(period, high_first).alias("best"), F.max("mean").alias("best_mean"),
        F.min_by(period, low_first).alias("worst"), F.min("mean").alias("worst_mean"),
    )
    return ends.where(F.col("_periods") > 1).select(
        "first_mean", "last_mean", (F.col("last_mean") - F.col("first_mean")).alias("change"),
        F.when(F.col("last_mean") > F.col("first_mean"), F.lit("IMPROVING")).otherwise(F.lit("DECLINING")).alias("direction"),
        "best", "best_mean", "worst", "worst_mean",
    )
