import os

import pytest
from pyspark.sql import functions as F

from opinara.llm import language

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
def test_held_out_accuracy(spark):
    from opinara.llm.queries import op1_language

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    rows = op1_language(spark, SF).where("held_out").join(docs, "doc_id").where(F.length("text") > 200).collect()
    assert rows and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_profiles_match_brute_force(spark):
    from collections import Counter

    texts = [("x", "Abba  abc"), ("x", "b1c"), ("y", "ÄÖ äö"), (None, "zzz"), ("y", None), ("z", "12 !")]
    df = spark.createDataFrame(texts, "lang string, text string")
    counts = {}
    for lang, text in texts:
        if lang and text:
            for word in "".join(c.lower() if c.isalpha() else " " for c in text).split():
                w = f" {word} "
                grams = [w[i:i + n] for n in (2, 3) for i in range(len(w) - n + 1)] + list(word)
                # A gap between two words is shared, as is the pair that begins the next word.
                counts.setdefault(lang, Counter()).update(grams)

    def key(gram):
        k = 0
        for c in gram:
            k = (k << 21) | ord(c)
        return k

    found = {(r["lang"], r["gram"]): r["rank"] for r in language.learn(df, "text", "lang", 10_000).collect()}
    expected = {}
    for lang, c in counts.items():
        for rank, (gram, _) in enumerate(sorted(c.items(), key=lambda e: (-e[1], key(e[0])))):
            expected[lang, key(gram)] = rank
    assert found == expected


def test_distance():
    p = language.Profiles([("a", ord("x"), 0), ("b", ord("y"), 0)], size=3)
    grams = language.ngrams("x")
    assert len(grams) == 4  # x, " x", "x ", " x "
    assert p.judge("x") == ("a", 1 - 6 / 9) and p.judge("1 !") == ("und", 0.0) and p.judge(None) == ("und", 0.0)


def test_odd_rows(documents, no_documents):
    profiles = language.fit(documents)
    out = language.predict(documents, profiles).collect()
    assert len(out) == documents.count()
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in out)
    assert language.predict(no_documents, profiles).collect() == []
    nothing = language.fit(no_documents)
    assert {r["lang_pred"] for r in language.predict(documents, nothing).collect()} == {"und"}
