from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.session import scratch_path
from opinara.streaming import ingest

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType()),
                       T.StructField("text", T.StringType()), T.StructField("compound", T.DoubleType())])


def write(spark, path, rows):
    frame = spark.createDataFrame(rows, "id long, ts string, text string, compound double")
    frame.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


def test_counts_equal_the_batch_result_and_late_rows_are_dropped(spark):
    path = scratch_path(spark, "stream")
    write(spark, path, [(1, "2024-01-01 10:00", "A good one", 0.5), (2, "2024-01-01 11:00", "bad", -0.5), (2, "2024-01-01 11:00", "bad", -0.5),
                        (3, "2024-01-02 09:00", "fine", 0.5), (4, "2024-01-02 10:00", "www.only.link", 0.5)])
    stream = ingest.labelled(ingest.open_stream(spark, path, SCHEMA, files_per_batch=1), "compound", "text")
    counts = ingest.daily_counts(ingest.first_seen(stream, ["id"], "ts", "1 day"), "ts", ["sentiment_label"])
    keys = ["day", "sentiment_label"]
    got = sorted((str(r["day"])[:10], r["sentiment_label"], r["n"]) for r in ingest.run_available(counts, keys, scratch_path(spark, "out"), scratch_path(spark, "state")).counts.collect())
    assert got == [("2024-01-01", "negative", 1), ("2024-01-01", "positive", 1), ("2024-01-02", "positive", 1)]


def test_rows_behind_the_watermark_do_not_count(spark):
    """Late rows are judged by the watermark of the batch before, so one more batch lies in between."""
    import time

    path = scratch_path(spark, "stream")
    for batch in ([(1, "2024-01-10 10:00", "a", 0.5)], [(2, "2024-01-20 10:00", "b", 0.5)],
                  [(5, "2024-01-21 10:00", "d", 0.5)], [(3, "2024-01-10 11:00", "late", 0.5), (4, "2024-01-20 11:00", "c", 0.5)]):
        write(spark, path, batch)
        time.sleep(1.1)
    stream = ingest.labelled(ingest.open_stream(spark, path, SCHEMA, files_per_batch=1), "compound", "text")
    counts = ingest.daily_counts(stream.withWatermark("ts", "1 day"), "ts", ["sentiment_label"])
    done = ingest.run_available(counts, ["day", "sentiment_label"], scratch_path(spark, "out"), scratch_path(spark, "state"))
    got = sorted((str(r["day"])[:10], r["n"]) for r in done.counts.collect())
    assert done.late_rows == 1
    assert got == [("2024-01-10", 1), ("2024-01-20", 2), ("2024-01-21", 1)]


def test_a_later_run_goes_on_where_the_first_ended(spark):
    path, out, state = (scratch_path(spark, x) for x in ("stream", "out", "state"))

    def run():
        stream = ingest.labelled(ingest.open_stream(spark, path, SCHEMA), "compound", "text")
        counts = ingest.daily_counts(ingest.first_seen(stream, ["id"], "ts", "1 day"), "ts", ["sentiment_label"])
        done = ingest.run_available(counts, ["day", "sentiment_label"], out, state)
        return sorted((str(r["day"])[:10], r["n"]) for r in done.counts.collect())

    write(spark, path, [(1, "2024-01-01 10:00", "a", 0.5), (2, "2024-01-01 11:00", "b", 0.5)])
    assert run() == [("2024-01-01", 2)]
    assert run() == [("2024-01-01", 2)]
    write(spark, path, [(2, "2024-01-01 11:00", "b", 0.5), (3, "2024-01-01 12:00", "c", 0.5), (4, "2024-01-02 01:00", "d", 0.5)])
    assert run() == [("2024-01-01", 3), ("2024-01-02", 1)]
