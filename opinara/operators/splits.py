"""Label encoding, stratified splits and class weights.

Class counts are a few rows (one per label a classifier can learn), so they are read as one map through a
scalar subquery, guarded by ``MAX_CLASSES``; the table itself is only scanned and never shuffled by class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.operators.limits import hash_key
from opinara.operators.prefix import rank_thresholds

MAX_CLASSES = 10_000


def _class_map(per_class: DataFrame, label: str, value: Column) -> Column:
    guarded = per_class.agg(
        F.when(F.count("*") > MAX_CLASSES, F.raise_error(F.lit("too many classes"))).otherwise(
            F.map_from_entries(F.collect_list(F.struct(F.col(label), value)))
        ).alias("m")
    )
    return guarded.scalar()


def class_index(df: DataFrame, label: str, out: str = "label_index") -> DataFrame:
    """Position of the label in alphabetical order."""
    labels = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    guarded = labels.agg(
        F.when(F.count("*") > MAX_CLASSES, F.raise_error(F.lit("too many classes"))).otherwise(
            F.array_sort(F.collect_list(label))
        ).alias("a")
    )
    return df.withColumn(out, (F.array_position(guarded.scalar(), F.col(label)) - 1).cast("int"))


def stratified_split(
    df: DataFrame, row_id: str, label: str, fractions: dict[str, float], rest: str = "train", seed: int = 42,
    out: str = "split",
) -> DataFrame:
    """Exact share of every class in each named part, the remainder in ``rest``.

    Rows are ordered by a hash of their id; the hash value at which a part ends is found per class, and rows
    are then labelled in place. The outcome does not depend on partitioning.
    """
    keyed = df.withColumn("_hash", hash_key(row_id, seed))
    cumulative, cuts = 0.0, {}
    for name, p in fractions.items():
        cumulative += p
        cuts[name] = F.round(F.col("total") * F.lit(round(cumulative, 10)))
    ends = rank_thresholds(keyed, label, "_hash", cuts)
    # A class whose rounded share is zero rows has no end row and is absent here.
    by_class = _class_map(ends, label, F.struct(*cuts))
    end = F.element_at(by_class, F.col(label))
    parts = F
    for name in cuts:
        parts = parts.when(F.col("_hash") <= end[name], F.lit(name))
    return keyed.withColumn(out, parts.otherwise(F.lit(rest))).drop("_hash")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight of each class: rows / (classes * rows of the class)."""
    per_class = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = per_class.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"))
    rows, classes = totals.select("rows").scalar(), totals.select("classes").scalar()
    return per_class.withColumn("weight", rows / (classes * F.col("n")))


def with_class_weight(df: DataFrame, label: str, out: str = "class_weight") -> DataFrame:
    by_class = _class_map(class_weights(df, label), label, F.col("weight"))
    return df.withColumn(out, F.element_at(by_class, F.col(label)))
