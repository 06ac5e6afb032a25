"""Exact running sums, quantiles and rank picks without a single-task sort.

A window over a whole table, or over one hot group, runs in one task. Here the values are first cut into ranges whose
number follows from the number of rows. Exact sums per range give the offsets (one row per range) and sorting happens
inside single ranges only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinara.operators.sizing import measured

SKETCH_ACCURACY = 10_000
#: Rows that one range of a running sum, or one hash bucket of a rank pick, holds on average at most.
ROWS_PER_RANGE = 1_000_000


def with_prefix_sums(
    df: DataFrame, keys: list[str], order_by: str, sums: list[str], rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Add ``<c>_before`` (sum over smaller ``order_by``) and ``<c>_total`` for each summed column.

    ``order_by`` must be unique within ``keys``; without keys the sum runs over the whole table. The rows are written
    and counted, then dealt into as many ranges of the order as the count asks for, whatever group they belong to.
    """
    rows = measured(df, "rows")
    ranges = max(1, -(-rows.count() // rows_per_range))
    dealt = rows.repartitionByRange(ranges, *keys, order_by).withColumn("_range", F.spark_partition_id())
    dealt = measured(dealt, "ranges")

    in_group = W.partitionBy(*keys)
    earlier = in_group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = dealt.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_{c}_sum") for c in sums])
    offsets = offsets.select(
        *keys,
        "_range",
        *[F.coalesce(F.sum(f"_{c}_sum").over(earlier), F.lit(0)).alias(f"_{c}_offset") for c in sums],
        *[F.sum(f"_{c}_sum").over(in_group).alias(f"{c}_total") for c in sums],
    )

    inside = W.partitionBy(*keys, "_range").orderBy(order_by).rowsBetween(W.unboundedPreceding, -1)
    local = dealt.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_{c}_local") for c in sums])
    joined = local.join(offsets, [*keys, "_range"])
    for c in sums:
        joined = joined.withColumn(f"{c}_before", F.col(f"_{c}_offset") + F.col(f"_{c}_local"))
    return joined.drop("_range", *[f"_{c}_offset" for c in sums], *[f"_{c}_local" for c in sums])


def measures(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row ``(keys, measure, value)`` per non-null value of each listed column."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("value")) for v in values
    ]))
    return df.select(*keys, pairs.alias("_p")).select(*keys, "_p.measure", "_p.value").where(F.col("value").isNotNull())


def exact_quantiles(df: DataFrame, keys: list[str], values: list[str], probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group: one row per ``(keys, measure)``, one column per entry.

    A sketch gives a narrow range of values around each quantile. Exact counts per range then tell in which
    range each wanted rank lies, whatever the quality of the sketch, and only the distinct values of those
    ranges are shuffled and sorted. The table itself is scanned three times and never shuffled; persist it
    first when its columns are expensive to compute.
    """
    groups = [*keys, "measure"]
    margin = 2 / SKETCH_ACCURACY
    steps = sorted({min(1.0, max(0.0, p + m)) for p in probs.values() for m in (-margin, margin)})
    rows = measures(df, keys, values)
    cuts = measured(rows.groupBy(*groups).agg(F.percentile_approx("value", steps, SKETCH_ACCURACY).alias("_cuts")))
    segment = F.lit(0)
    for i in range(len(steps)):
        segment = segment + (F.col("value") > F.get("_cuts", F.lit(i))).cast("int")
    placed = rows.join(cuts, groups).select(*groups, "value", segment.alias("_segment"))

    in_group = W.partitionBy(*groups)
    earlier = in_group.orderBy("_segment").rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.groupBy(*groups, "_segment").agg(F.count("*").alias("_size")).select(
        *groups, "_segment", "_size",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
        (F.sum("_size").over(in_group) - 1).alias("_last"),
    )
    entries = []
    for name, p in probs.items():
        position = F.lit(p) * F.col("_last")
        for side, rank in (("low", F.floor(position)), ("high", F.ceil(position))):
            entries.append(F.struct(
                F.lit(f"{name}_{side}").alias("pick"), rank.alias("rank"), (position - F.floor(position)).alias("fraction")
            ))
    wanted = sizes.select("*", F.explode(F.array(*entries)).alias("_w")).select(*groups, "_segment", "_size", "_before", "_w.*")
    wanted = measured(
        wanted.where((F.col("_before") <= F.col("rank")) & (F.col("rank") < F.col("_before") + F.col("_size")))
        .select(*groups, "_segment", "pick", (F.col("rank") - F.col("_before")).alias("_rank"), "fraction")
    )
    counts = (
        placed.join(wanted, [*groups, "_segment"], "left_semi")
        .groupBy(*groups, "_segment", "value").agg(F.count("*").alias("_n"))
    )
    ranked = with_prefix_sums(counts, [*groups, "_segment"], "value", ["_n"]).withColumnRenamed("_n_before", "_first")
    picked = ranked.join(wanted, [*groups, "_segment"]).where(
        (F.col("_first") <= F.col("_rank")) & (F.col("_rank") < F.col("_first") + F.col("_n"))
    )

    def value_of(pick: str, column: str = "value") -> Column:
        return F.max(F.when(F.col("pick") == pick, F.col(column)))

    results = []
    for name in probs:
        low, high = value_of(f"{name}_low"), value_of(f"{name}_high")
        results.append((low + (high - low) * value_of(f"{name}_low", "fraction")).alias(name))
    return picked.groupBy(*groups).agg(*results)


def rank_thresholds(
    df: DataFrame, group: str, hash_key: str, cuts: dict[str, Column], rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Per group, the value of ``hash_key`` (hexadecimal text) that ends the first ``k`` rows, for each cut.

    ``cuts`` maps an output name to ``k`` as an expression over ``total``. The leading characters of the hash
    are the bucket, as many of them as the number of rows asks for; only the bucket in which a cut falls is sorted.
    Zero rows give an empty string.
    """
    keyed = measured(df.select(F.col(group).alias("_g"), F.col(hash_key).alias("_h")), "hashes")
    rows, prefix_chars = keyed.count(), 1
    while rows > rows_per_range * 16**prefix_chars:
        prefix_chars += 1
    keyed = keyed.withColumn("_bucket", F.substring("_h", 1, prefix_chars))
    hist = keyed.groupBy("_g", "_bucket").agg(F.count("*").alias("_n"))
    in_group = W.partitionBy("_g")
    hist = hist.select(
        "_g", "_bucket", "_n",
        F.sum("_n").over(in_group).alias("total"),
        F.coalesce(F.sum("_n").over(in_group.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        .alias("_before"),
    )
    wanted = F.explode(F.array(*[
        F.struct(F.lit(name).alias("cut"), k.cast("long").alias("k")) for name, k in cuts.items()
    ]))
    edges = hist.select("*", wanted.alias("_w")).select("_g", "_bucket", "_n", "_before", "_w.cut", "_w.k")
    edges = edges.where((F.col("_before") < F.col("k")) & (F.col("k") <= F.col("_before") + F.col("_n")))
    rank = F.row_number().over(W.partitionBy("_g", "cut").orderBy("_h"))
    return (
        keyed.join(measured(edges.select("_g", "_bucket", "cut", (F.col("k") - F.col("_before")).alias("_need"))), ["_g", "_bucket"])
        .withColumn("_rank", rank)
        .where(F.col("_rank") == F.col("_need"))
        .groupBy(F.col("_g").alias(group))
        .pivot("cut", list(cuts))
        .agg(F.first("_h"))
        .fillna("")
    )
