import time

from pyspark.sql import functions as F

from opinara.session import scratch_path
from opinara.streaming import ingest, relevant

GOOD = "I think AI is something new and it would change the future of every job"
SCHEMA = "seq long, video string, ts timestamp, body string, compound double"
LISTS = {"ai": (["ai"], ["machine learning"]), "opinion": ["think"], "societal": ["job"]}


def write(spark, path, rows):
    frame = spark.createDataFrame(rows, "seq long, video string, ts string, body string, compound double")
    frame.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.1)  # files are read in the order of their times


def stream_of(spark, path, limit=3, delay="1 day"):
    rows = ingest.open_stream(spark, path, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    return relevant.collected(rows, "video", "body", "compound", "ts", "seq", delay, limit, **LISTS)


FILES = [
    [(3, "a", "2024-01-01 10:00", GOOD + " three", 0.5), (1, "a", "2024-01-01 10:00", GOOD + " one", 0.5), (2, "b", "2024-01-01 11:00", GOOD + " one", 0.5),
     (4, "a", "2024-01-01 12:00", "not about it, of no use to any one of us here now", 0.9), (5, "b", "2024-01-01 12:00", GOOD + " http://x.y five", 0.1)],
    [(6, "a", "2024-01-01 13:00", GOOD + " six", 0.5), (7, "a", "2024-01-01 13:00", GOOD + " seven", 0.5), (8, "b", "2024-01-01 13:30", GOOD + "   three", 0.5)],
    [(9, "a", "2024-01-01 14:00", GOOD + " nine", 0.5), (10, "b", "2024-01-01 14:00", GOOD + " ten", 0.5), (11, "b", "2024-01-01 14:00", GOOD + " ten", 0.5)],
]
EXPECTED = ([1, 3, 5, 6, 10], {"kept": 5, "repeated": 3, "capped": 2})


def result(done):
    return sorted(r["seq"] for r in done.kept.collect()), {r["verdict"]: r["n"] for r in done.verdicts.collect()}


def test_three_runs_equal_one_and_a_plain_reckoning(spark):
    whole, parts = scratch_path(spark, "whole"), scratch_path(spark, "parts")
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    for rows in FILES:
        write(spark, whole, rows)
        write(spark, parts, rows)
        three = relevant.run(stream_of(spark, parts), out, state)
    one = relevant.run(stream_of(spark, whole), scratch_path(spark, "out"), scratch_path(spark, "state"))
    assert result(three) == result(one) == EXPECTED
    assert {r["body"] for r in three.kept.where("seq = 5").collect()} == {GOOD + " five"}
    again = relevant.run(stream_of(spark, parts), out, state)
    assert result(again) == EXPECTED


def test_late_rows_are_dropped_and_old_texts_forgotten(spark):
    path = scratch_path(spark, "stream")
    for rows in ([(1, "a", "2024-01-01 10:00", GOOD, 0.5)], [(2, "b", "2024-01-20 10:00", GOOD + " two", 0.5)],
                 [(3, "c", "2024-01-21 10:00", GOOD + " three", 0.5)], [(4, "d", "2024-01-01 11:00", GOOD + " late", 0.5), (5, "e", "2024-01-21 11:00", GOOD, 0.5)]):
        write(spark, path, rows)
    done = relevant.run(stream_of(spark, path), scratch_path(spark, "out"), scratch_path(spark, "state"))
    assert result(done) == ([1, 2, 3, 5], {"kept": 4}) and done.late_rows == 1
