"""One query per operator over the given tables, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import codes, credentials, decontaminate, language, licenses, links, near, packing, personal, records, repeats, rules, whitening
from opinara.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    profiles = language.fit(docs.where(F.col("doc_id").isNotNull() & ~held_out))
    judged = language.predict(docs.select("doc_id", "text"), profiles)
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op2_rules(spark, sf_dir):
    entries = rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rules.judged(entries, rules.POLICIES[rules.CURRENT]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rules.failing(rules.BASE).alias("base_failed"), "kept", "n_lines", "failure_bits",
    )


@query
def op3_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.packed(packing.pieces(docs, vocabulary("word_bpe_49k.json"), end_id=1))


@query
def op4_secrets(spark, sf_dir):
    found = credentials.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(credentials.listed(base).cast("binary"), 256).alias("base_sha256"), credentials.listed(F.col("spans")).alias("spans"), "n_live",
    )


@query
def op5_links(spark, sf_dir):
    judged = links.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op6_near(spark, sf_dir):
    return near.link(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2, similarity=80)


@query
def op7_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "n_items", F.array_join(F.col("item_ids").cast("array<string>"), ",").alias("item_ids"),
                        F.round("similarity", 6).alias("similarity"))


@query
def op8_repeats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove(docs, keep_first=False, with_bytes=False)


@query
def op9_licenses(spark, sf_dir):
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query
def op10_records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = records.write(docs, vocabulary("byte_bpe_50k.json"), end_id=2)
    placed = records.with_start(index)
    return records.read(placed, keep=("start",), with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op11_personal(spark, sf_dir):
    found = personal.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("email"), count("ip"), count("card"), count("phone"),
        F.sha2(personal.listed(base).cast("binary"), 256).alias("base_sha256"), personal.listed(F.col("spans")).alias("spans"),
    )


@query
def op12_codes(spark, sf_dir):
    return codes.encode(table(spark, sf_dir, "embeddings")).drop("label")


@query
def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
