"""Lemmas from a ``(form, lemma)`` table."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.text import tokens

#: Forms that a table may have. Those of a language run to some hundred thousand.
MAX_FORMS = 1_000_000
#: Forms that share a bucket, on average.
BUCKET_FORMS = 4


def dictionary(lemmas: DataFrame) -> Callable[[Column], Column]:
    """A function from a word to its lemma, or to the word itself.

    The table, which is a dictionary and does not grow with the texts, becomes one constant of the plan: small maps,
    found by the hash of a word, so a word costs the same with ten forms and with hundreds of thousands. No token leaves
    its row. Of several lemmas of a form the smallest counts.
    """
    known = lemmas.where("form IS NOT NULL AND lemma IS NOT NULL").groupBy("form").agg(F.min("lemma").alias("lemma")).limit(MAX_FORMS + 1)
    rows = known.select("form", "lemma", F.xxhash64("form").alias("h")).collect()
    if len(rows) > MAX_FORMS:
        raise ValueError(f"a lemma table of more than {MAX_FORMS} forms does not fit a plan")
    n = max(1, len(rows) // BUCKET_FORMS)
    buckets: list[dict[str, str]] = [{} for _ in range(n)]
    for r in rows:
        buckets[r["h"] % n][r["form"]] = r["lemma"]
    # One literal instead of one for each form; it is read once, when the plan is made.
    constant = F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False)), "array<map<string,string>>")

    def lemma(word: Column) -> Column:
        here = F.get(constant, F.pmod(F.xxhash64(word), F.lit(n)).cast("int"))
        return F.coalesce(F.try_element_at(here, word), word)

    return lemma


def lemmatise(df: DataFrame, text: str, lemmas: DataFrame, out: str = "lemmatised") -> DataFrame:
    """Replace each word that has a lemma and leave the others."""
    lemma = dictionary(lemmas)
    words = F.transform(tokens(text), lambda w: lemma(w))
    return df.withColumn(out, F.coalesce(F.array_join(words, " "), F.lit("")))
