"""Descriptive aggregates. Each is one partial + final aggregation unless its docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinara.functions.scores import share, verdict
from opinara.operators.prefix import exact_quantiles
from opinara.operators.shaping import row_digest, rows_from
from opinara.operators.sizing import measured


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Non-null values by falling count, ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column)


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Value counts with their percentage of all non-null rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = df.agg(F.count(column).alias("total")).scalar()
    return counts.withColumn("pct", share("n", total))


def group_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def group_stats(df: DataFrame, key: str, counted: str, averaged: dict[str, str], digits: int | None = 2) -> DataFrame:
    """Count of one column and means of others; rounding is half to even."""
    def shown(c: Column) -> Column:
        return F.bround(c, digits) if digits is not None else c

    return df.groupBy(key).agg(
        F.count(counted).alias("n"), *[shown(F.avg(c)).alias(out) for out, c in averaged.items()]
    )


def group_means(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(v).alias(f"mean_{v}") for v in values])


def crosstab(df: DataFrame, row: str, column: str, values: list[str], percent: bool = True) -> DataFrame:
    """Counts of ``column`` values per ``row``, as a percentage of the row.

    The values are given, so no extra job looks for them; rows with another value count in neither.
    """
    hit = {v: F.count_if(F.col(column) == v) for v in values}
    known = df.where(F.col(row).isNotNull() & F.col(column).isin(values))
    if not percent:
        return known.groupBy(row).agg(*[c.alias(v) for v, c in hit.items()])
    return known.groupBy(row).agg(*[share(c, F.count("*")).alias(v) for v, c in hit.items()])


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, sample deviation, minimum, maximum and sum of each column, one row per column, one pass."""
    aggregates = []
    for c in columns:
        aggregates += [
            F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std"), F.min(c).alias(f"{c}__min"),
            F.max(c).alias(f"{c}__max"), F.sum(c).alias(f"{c}__sum"), F.count(c).alias(f"{c}__count"),
        ]
    return rows_from(df.agg(*aggregates), [
        {"measure": F.lit(c), "count": F.col(f"{c}__count"),
         **{k: F.col(f"{c}__{k}").cast("double") for k in ("mean", "std", "min", "max", "sum")}}
        for c in columns
    ])


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles (exact, interpolated) and maximum per column."""
    return summary(df, columns).drop("sum").join(exact_quantiles(df, [], columns, QUARTILES), "measure", "left")


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact medians. The columns are computed once and written, as finding a rank reads them more than once."""
    return exact_quantiles(measured(df.select(*columns), "values"), [], columns, {"median": 0.5})


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Number of distinct values of each column, nulls not counted.

    Rows become (column, digest) pairs inside the task, which combines equal ones before the shuffle; no row is copied
    with all its columns for each of them, and long texts do not move.
    """
    if approximate:
        return df.agg(*[F.approx_count_distinct(F.col(c)).alias(c) for c in columns])
    doubles = [f.name for f in df.schema.fields if f.name in columns and f.dataType.typeName() in ("float", "double")]
    df = df.select(*columns).withColumns({c: F.col(c) + F.lit(0.0).cast(df.schema[c].dataType) for c in doubles})  # -0.0 is 0.0
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("c"), F.when(F.col(c).isNotNull(), row_digest(c)).alias("d")) for i, c in enumerate(columns)
    ])).alias("_p")).select("_p.c", "_p.d")
    each = pairs.where(F.col("d").isNotNull()).groupBy("c", "d").agg(F.lit(1).alias("_one")).groupBy("c").agg(F.count("*").alias("n"))
    return each.agg(*[F.coalesce(F.max(F.when(F.col("c") == i, F.col("n"))), F.lit(0)).alias(c) for i, c in enumerate(columns)])


def missing_report(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """Missing values per column with percentage, most first."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    report = rows_from(counts, [
        {"column": F.lit(c), "missing": F.col(c), "pct": share(c, "_rows")} for c in df.columns
    ])
    if only_missing:
        report = report.where(F.col("missing") > 0)
    return report.orderBy(F.desc("missing"), "column")


def missing_total(df: DataFrame) -> DataFrame:
    return missing_report(df).agg(F.sum("missing").alias("missing"))


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier row; nulls compare equal.

    Rows are reduced to a digest first, so long texts are never shuffled.
    """
    names = columns or df.columns
    groups = df.select(row_digest(*names).alias("_d")).groupBy("_d").agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def correlation(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate over rows where both are present; NULL for a constant column."""
    cx = F.when(F.col(y).isNotNull(), F.col(x)).cast("double")
    cy = F.when(F.col(x).isNotNull(), F.col(y)).cast("double")
    return F.try_divide(F.covar_pop(cx, cy), F.stddev_pop(cx) * F.stddev_pop(cy))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """All pairs in one aggregation: one row per column, one column per column."""
    pairs = {(a, b): f"{i}_{j}" for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j}
    stats = df.agg(*[correlation(a, b).alias(name) for (a, b), name in pairs.items()])
    return rows_from(stats, [
        {"feature": F.lit(a), **{b: F.col(pairs.get((a, b)) or pairs[(b, a)]) for b in columns}} for a in columns
    ])


def flag_summary(df: DataFrame, flags: list[str]) -> DataFrame:
    """Rows where each flag is set and their percentage."""
    aggregates = [F.count("*").alias("_rows")] + [F.sum(F.col(f).cast("int")).alias(f) for f in flags]
    return rows_from(df.agg(*aggregates), [
        {"flag": F.lit(f), "n": F.col(f), "pct": share(f, "_rows")} for f in flags
    ])


def conditional_means(df: DataFrame, flags: list[str], value: str) -> DataFrame:
    means = df.agg(*[F.avg(F.when(F.col(f).cast("boolean"), F.col(value))).alias(f) for f in flags])
    return rows_from(means, [{"flag": F.lit(f), "mean": F.col(f)} for f in flags])


def share_above(df: DataFrame, column: str, bound: float = 0) -> DataFrame:
    return df.agg(F.avg(column).alias("mean"), share(F.count_if(F.col(column) > bound), F.count("*")).alias("pct"))


def sums_and_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """Total of each column and its percentage of all totals."""
    totals = df.agg(*[F.sum(c).alias(c) for c in columns])
    whole = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return rows_from(totals, [{"column": F.lit(c), "total": F.col(c), "pct": share(c, whole)} for c in columns])


def column_means(df: DataFrame, columns: list[str]) -> DataFrame:
    means = df.agg(*[F.avg(c).alias(c) for c in columns])
    return rows_from(means, [{"column": F.lit(c), "mean": F.col(c)} for c in columns])


def best_group(df: DataFrame, key: str, value: str, largest: bool = True) -> DataFrame:
    """Group with the largest (or smallest) mean; ties go to the smallest key."""
    means = df.groupBy(key).agg(F.avg(value).alias("mean"))
    return means.orderBy(F.desc("mean") if largest else F.asc("mean"), key).limit(1)


def date_span(df: DataFrame, ts: str) -> DataFrame:
    from opinara.functions.calendar import whole_days

    bounds = df.agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    return bounds.select(
        "first", "last", whole_days("first", "last").alias("days"),
        F.year("first").alias("first_year"), F.year("last").alias("last_year"),
    )


def overall_verdict(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.avg(value).alias("mean")).select("mean", verdict("mean").alias("verdict"))


def _bins(value: Column, low: Column, high: Column, bins: int) -> Column:
    """One-based bin; the largest value belongs to the last bin."""
    return F.least(F.floor(F.lit(bins) * (value - low) / (high - low)) + 1, F.lit(bins)).cast("int")


def histogram(df: DataFrame, column: str, bins: int, by: str | None = None, by_values: list[str] | None = None) -> DataFrame:
    """Equal-width histogram with empty bins, for the whole table or for each listed class.

    The bounds are one row per class, written once and joined back, so only bin counts are shuffled. A constant column
    gets the range plus or minus one half; a class without values has no bins.
    """
    rows = df.where(F.col(by).isin(by_values)) if by else df
    rows = rows.select((F.col(by) if by else F.lit("all")).alias("class"), F.col(column).cast("double").alias("_v"))
    rows = rows.where(F.col("_v").isNotNull())
    ends = rows.groupBy("class").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    half = F.when(F.col("_low") == F.col("_high"), 0.5).otherwise(0.0)
    bounds = measured(ends.select("class", (F.col("_low") - half).alias("low"), (F.col("_high") + half).alias("high")), "bounds")
    binned = rows.join(bounds, "class").select("class", _bins(F.col("_v"), F.col("low"), F.col("high"), bins).alias("bin"))
    counts = binned.groupBy("class", "bin").agg(F.count("*").alias("n"))

    width = (F.col("high") - F.col("low")) / bins
    grid = bounds.select(
        "class", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), "low", width.alias("width")
    ).select(
        "class", "bin",
        (F.col("low") + (F.col("bin") - 1) * F.col("width")).alias("from_value"),
        (F.col("low") + F.col("bin") * F.col("width")).alias("to_value"),
    )
    filled = grid.join(counts, ["class", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled if by else filled.drop("class")


def box_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """Per class: range, exact quartiles, Tukey whiskers and the number of outliers."""
    rows = measured(df.where(F.col(by).isNotNull()).select(by, F.col(value).cast("double").alias("value")), "values")
    quartiles = exact_quantiles(rows, [by], ["value"], {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("measure")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fences = quartiles.withColumn("_low", F.col("q1") - reach).withColumn("_high", F.col("q3") + reach)
    inside = F.col("value").between(F.col("_low"), F.col("_high"))
    return rows.where(F.col("value").isNotNull()).join(measured(fences), by).groupBy(by, "q1", "median", "q3").agg(
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def split_balance(df: DataFrame, label: str, split: str) -> DataFrame:
    """Rows per split and class with the percentage of the split."""
    counts = df.groupBy(split, label).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", share("n", F.sum("n").over(W.partitionBy(split))))


def scatter(df: DataFrame, x: str, y: str, by: str, fractions: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """Points for a scatter chart; ``fractions`` thins each class by a repeatable sample."""
    points = df.select(F.col(by).alias("class"), F.col(x).alias("x"), F.col(y).alias("y"))
    return points.sampleBy("class", fractions, seed) if fractions else points


