"""Queries that read tables as file streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.functions import text
from opinara.queries import tables as t
from opinara.queries.registry import query
from opinara.session import scratch_path
from opinara.streaming import ingest, relevant


def _stream(spark, sf):
    schema = t.table(spark, sf, "events").schema
    stream = ingest.open_stream(spark, sf, schema, pattern="events.parquet")
    return ingest.labelled(stream.withColumn("compound", (F.col("value") - 50) / 500), "compound", "props")


@query("n01_daily_counts", f"WITH {t.EVENTS} SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, label AS sentiment_label, count(*) AS n FROM ev GROUP BY 1, 2, 3")
def n01(spark, sf):
    """Rows per day, type and label, from a stream with repeats of an event dropped."""
    first = ingest.first_seen(_stream(spark, sf), ["event_id"], "ts", "2 days")
    counts = ingest.daily_counts(first, "ts", ["event_type", "sentiment_label"])
    out, state = scratch_path(spark, "daily-counts"), scratch_path(spark, "daily-counts-state")
    done = ingest.run_available(counts, ["day", "event_type", "sentiment_label"], out, state)
    return done.counts.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("n01_relevant_turns", f"""WITH c AS (SELECT conv_id, turn, role, {t.s_platform_b('text')} AS c FROM conversations)
  SELECT role, count(*) AS n FROM c WHERE {t.s_words('c')} BETWEEN 10 AND 300 GROUP BY role""")
def n01_turns(spark, sf):
    """Turns that pass the length filter of platform B, cleaned as they arrive, counted by role in two runs."""
    schema = t.table(spark, sf, "conversations").schema
    out, state = scratch_path(spark, "turns"), scratch_path(spark, "turns-state")
    folder = scratch_path(spark, "turns-input")
    rows = t.table(spark, sf, "conversations")
    for part in (0, 1):
        rows.where(F.col("conv_id") % 2 == part).write.mode("append").parquet(folder)
        stream = ingest.open_stream(spark, folder, schema)
        cleaned = stream.withColumn("c", text.clean_platform_b("text"))
        kept = cleaned.where(text.word_count("c", collapsed=True).between(10, 300))
        done = ingest.run_available(kept.groupBy("role").agg(F.count("*").alias("n")), ["role"], out, state)
    return done.counts


_COLLECTED = f"""WITH c AS (SELECT conv_id * 1000 + turn AS seq, 'v' || (conv_id % 40) AS video, conv_id % 3 AS part,
    (((conv_id * 1000 + turn) * 37) % 201 - 100) / 100.0::DOUBLE AS compound, {t.s_platform_b('text')} AS body FROM conversations),
  k AS (SELECT * FROM c WHERE {t.s_relevant_b('body', 'compound')}),
  f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY body ORDER BY part, seq) = 1),
  l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY video ORDER BY part, seq) <= 5)
  SELECT seq, video, body, (SELECT count(*) FROM k) - (SELECT count(*) FROM f) AS n_repeated,
    (SELECT count(*) FROM f) - (SELECT count(*) FROM l) AS n_capped FROM l"""


@query("n01_collected_turns", _COLLECTED)
def n01_collected(spark, sf):
    """Turns that pass the relevance rule, each text once and five per video, arriving in three runs of one stream."""
    seq, part = F.col("conv_id") * 1000 + F.col("turn"), F.col("conv_id") % 3
    rows = t.table(spark, sf, "conversations").select(
        seq.alias("seq"), F.concat(F.lit("v"), F.col("conv_id") % 40).alias("video"),
        F.timestamp_seconds(F.lit(1609459200) + part * 86400).alias("ts"), F.col("text").alias("body"),
        (((seq * 37) % 201 - 100) / F.lit(100.0)).alias("compound"), part.alias("part"),
    )
    folder, out, state = (scratch_path(spark, name) for name in ("comments", "collected", "collected-state"))
    schema = rows.drop("part").schema
    for p in range(3):
        rows.where(F.col("part") == p).drop("part").write.mode("append").parquet(folder)
        stream = ingest.open_stream(spark, folder, schema)
        done = relevant.run(relevant.collected(stream, "video", "body", "compound", "ts", "seq", "30 days", 5, **t.RULE_B), out, state)
    n = {r["verdict"]: r["n"] for r in done.verdicts.collect()}
    counts = {f"n_{v}": F.lit(n.get(v, 0)).cast("bigint") for v in (relevant.REPEATED, relevant.CAPPED)}
    return done.kept.select("seq", "video", "body").withColumns(counts)
