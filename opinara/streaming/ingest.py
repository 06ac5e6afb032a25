"""Comment ingest on a file stream: the row-level columns of the batch plans, then daily counts per class."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.functions import scores, text


def open_stream(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", pattern: str | None = None,
                files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def labelled(stream: DataFrame, compound: str, body: str | None = None) -> DataFrame:
    """Label, polarity flags and, when there is a text, its cleaned form; empty texts are dropped."""
    out = stream.withColumns({"sentiment_label": scores.sentiment_label(compound), **scores.polarity_flags(compound)})
    if body:
        out = out.withColumn("text_clean", text.clean_basic(body)).where(F.length("text_clean") > 0)
    return out


def first_seen(stream: DataFrame, subset: list[str], ts: str, delay: str) -> DataFrame:
    """Drop repeats that arrive within the watermark; state older than that is forgotten."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(subset)


def daily_counts(stream: DataFrame, ts: str, keys: list[str]) -> DataFrame:
    """Rows per day and key; the caller has set the watermark."""
    return stream.groupBy(F.window(ts, "1 day").alias("_day"), *keys).agg(F.count("*").alias("n")).select(
        F.col("_day.start").alias("day"), *keys, "n"
    )


@dataclass
class Progress:
    """The latest count of every key, and how many rows of this run came too late to be counted."""

    counts: DataFrame
    late_rows: int


def run_available(counts: DataFrame, keys: list[str], out: str, state: str) -> Progress:
    """Process what is there and return the latest count of every key.

    ``out`` and ``state`` are folders all executors share. A later call with the same two goes on where the last one
    ended, also one that was broken off: each micro-batch writes its changed rows to its own folder, which a repeated
    batch replaces, so a restart neither loses nor doubles a count.
    """
    spark = counts.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = (
        counts.writeStream.outputMode("update").option("checkpointLocation", state)
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    # A counting operator sees a late row once; the operators before it may report it too.
    late = sum(max((s["numRowsDroppedByWatermark"] for s in p["stateOperators"]), default=0) for p in query.recentProgress)
    written = spark.read.schema(T.StructType([*counts.schema.fields, T.StructField("batch_id", T.LongType())])).parquet(out)
    values = [c for c in counts.columns if c not in keys]
    return Progress(written.groupBy(*keys).agg(*[F.max_by(v, "batch_id").alias(v) for v in values]), late)
