"""Comment ingest with memory: the relevance rule, one comment per text, and a cap per video, all across restarts.

Two keyed states live in the state store. One remembers each text for as long as the watermark allows, the other how
many comments of a video were taken. Both see a micro-batch in the order of ``order``, so what is kept does
not depend on how rows are spread over tasks. Rows that are not kept go through with their verdict and without their
text, which makes repeats and capped comments countable; late rows are counted by the watermark.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from opinara import vocab
from opinara.functions import text
from opinara.operators import relevance

#: Keyed state with timers is kept in this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEPT, REPEATED, CAPPED = "kept", "repeated", "capped"


def relevant(stream: DataFrame, body: str, compound: str, **lists) -> DataFrame:
    """Rows that pass the relevance rule of platform B, with the cleaned text in place of the raw one."""
    cleaned = stream.withColumn(body, text.clean_platform_b(body))
    return cleaned.where(relevance.relevant_comment_b(body, compound, **lists))


def _ordered(frames, order: str):
    """The rows of a group in one micro-batch, in order."""
    import pandas as pd

    return pd.concat(list(frames), ignore_index=True).sort_values(order, ignore_index=True, kind="stable")


class OncePerText(StatefulProcessor):
    """Keeps the first row of a text and marks later ones as repeats until the text is forgotten."""

    def __init__(self, body: str, ts: str, order: str, span_ms: int):
        self.body, self.ts, self.order, self.span_ms = body, ts, order, span_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "until bigint")

    def handleInputRows(self, key, rows, timerValues):
        rows = _ordered(rows, self.order)
        rows["verdict"] = REPEATED
        if not self.seen.exists():
            rows.loc[0, "verdict"] = KEPT
        rows.loc[rows["verdict"] != KEPT, self.body] = None
        until = max(int(rows[self.ts].max().timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.span_ms + 1
        self.seen.update((until,))
        self.handle.registerTimer(until)
        yield rows

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # A text that was seen again has a later timer, too.
        if self.seen.exists() and self.seen.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


class CappedPerVideo(StatefulProcessor):
    """Turns kept rows beyond the first ``limit`` of a video, counted since the stream began, into capped ones."""

    def __init__(self, body: str, order: str, limit: int):
        self.body, self.order, self.limit = body, order, limit

    def init(self, handle) -> None:
        self.taken = handle.getValueState("taken", "n bigint")

    def handleInputRows(self, key, rows, timerValues):
        taken = self.taken.get()[0] if self.taken.exists() else 0
        rows = _ordered(rows, self.order)
        new = rows["verdict"] == KEPT
        over = new & (new.cumsum() + taken > self.limit)
        rows.loc[over, "verdict"] = CAPPED
        rows.loc[over, self.body] = None
        self.taken.update((int(min(self.limit, taken + new.sum())),))
        yield rows

    def close(self) -> None:
        pass


def once_per_text(stream: DataFrame, body: str, ts: str, order: str, delay: str) -> DataFrame:
    """Adds ``verdict``. A text is forgotten ``delay`` after it was last seen, by event time; rows later than that are late."""
    spark = stream.sparkSession
    span = spark.range(1).select(F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL '{delay}'"))).first()[0]
    fields = [T.StructField(f.name, f.dataType) for f in stream.schema.fields]  # a text may become null
    schema = T.StructType([*fields, T.StructField("verdict", T.StringType())])
    keyed = stream.withWatermark(ts, delay).withColumn("_text", F.sha2(body, 256))
    return keyed.groupBy("_text").transformWithStateInPandas(
        OncePerText(body, ts, order, span), schema, "append", "EventTime", eventTimeColumnName=ts)


def capped_per_video(stream: DataFrame, video: str, body: str, order: str, limit: int = vocab.COMMENTS_PER_VIDEO) -> DataFrame:
    """Caps the kept rows of ``once_per_text``."""
    keyed = stream.withColumn("_video", F.col(video))  # a function does not see the column that groups
    return keyed.groupBy("_video").transformWithStateInPandas(CappedPerVideo(body, order, limit), stream.schema, "append", "None")


def collected(stream: DataFrame, video: str, body: str, compound: str, ts: str, order: str, delay: str,
              limit: int = vocab.COMMENTS_PER_VIDEO, **lists) -> DataFrame:
    """Relevant comments with their verdict: kept, repeated or capped."""
    once = once_per_text(relevant(stream, body, compound, **lists), body, ts, order, delay)
    return capped_per_video(once, video, body, order, limit)


@dataclass
class Collected:
    """What all runs so far have kept, how many rows each verdict has, and the late rows of this run."""

    kept: DataFrame
    verdicts: DataFrame
    late_rows: int


def run(stream: DataFrame, out: str, state: str) -> Collected:
    """Process what is there. A later call with the same folders goes on where the last one ended.

    A micro-batch that is repeated after a break replaces its own folder, so no row is lost or doubled.
    """
    spark: SparkSession = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    # The store is set for this stream alone; others keep the one their state was written with.
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        query = (
            stream.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    late = sum(max((s["numRowsDroppedByWatermark"] for s in p["stateOperators"]), default=0) for p in query.recentProgress)
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])).parquet(out)
    kept = rows.where(F.col("verdict") == KEPT).drop("verdict", "batch_id")
    return Collected(kept, rows.groupBy("verdict").agg(F.count("*").alias("n")), late)
