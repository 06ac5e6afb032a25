"""The corpus pipeline: each stage takes (spark, docs, sf_dir), its result is written and read again as the next docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import credentials, decontaminate, near, packing, rules
from opinara.llm.common import measured
from opinara.llm.queries import table, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    entries = rules.judged(rules.ledger(docs), rules.POLICIES[rules.CURRENT])
    return entries.where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return near.deduplicated(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and ``n_chars`` counted anew where one was."""
    found = credentials.scan(docs)
    text = credentials.redacted(F.col("text"), F.col("spans"))
    changed = found.withColumn("_new", text)
    n_chars = F.when(F.col("n_spans") > 0, F.char_length("_new")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return changed.withColumns({"n_chars": n_chars, "text": F.col("_new")}).select(*docs.columns)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences."""
    return packing.packed(packing.pieces(docs, vocabulary("word_bpe_49k.json"), end_id=1))


STAGES = [
    ("quality", quality), ("near_dedup", near_dedup), ("decontaminate", clean_of_benchmarks), ("secrets", without_secrets),
    ("packing", best_fit),
]
# Tokenizing and the search for near-duplicates have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = measured(docs, f"stage-{name}")
    return docs
