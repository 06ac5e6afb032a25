import math

import pytest
from pyspark.sql import functions as F

from opinara.functions import calendar, scores
from opinara.operators import polarity


def test_label_thresholds_and_flags(spark):
    rows = spark.createDataFrame([(0.05,), (-0.05,), (0.0499,), (None,)], "c double")
    out = rows.select(scores.sentiment_label("c").alias("l"), *[v.alias(k) for k, v in scores.polarity_flags("c").items()]).collect()
    assert [r["l"] for r in out] == ["positive", "negative", "neutral", "neutral"]
    assert [r["is_positive"] + r["is_negative"] + r["is_neutral"] for r in out] == [1, 1, 1, 0]


def test_engagement_with_down_votes(spark):
    rows = spark.createDataFrame([(-5, 0), (3, 2)], "likes long, replies long").withColumn("s", scores.engagement("likes", "replies"))
    out = rows.select("s", scores.engagement_log("s").alias("g")).collect()
    assert [r["s"] for r in out] == [-5, 7]
    assert out[0]["g"] is None and out[1]["g"] == pytest.approx(math.log1p(7))


def test_subjectivity_is_capped(spark):
    t = "I think it should be the best, clearly"
    rows = spark.createDataFrame([(t, 1.0), (t, -1.0), ("plain", 0.4), ("bestial", 0.0)], "t string, c double")
    assert [r[0] for r in rows.select(scores.subjectivity("t", "c")).collect()] == [1.0, 1.0, 0.2, 0.0]


def test_dates(spark):
    rows = spark.createDataFrame([("bad",), ("2024-03-04T05:06:07Z",), ("2024-03-04T05:06:07+00:00",), (None,)], "s string")
    parsed = rows.select(calendar.parse_iso("s").alias("t"))
    assert [str(r["t"]) for r in parsed.collect()] == ["None", "2024-03-04 05:06:07", "2024-03-04 05:06:07", "None"]
    p = calendar.parts("t")
    last = parsed.where("t is not null").select(*[c.alias(k) for k, c in p.items()], calendar.month_name("t").alias("n"), calendar.iso_text("t").alias("i")).first()
    assert tuple(last) == (2024, 3, 0, 5, "March", "2024-03-04T05:06:07+00:00")


LEXICON = [("good", 1.9), ("bad", -2.5), ("great", 3.1), ("no", -1.2), ("kind", 2.4), ("fun", 2.3)]
# Worked out by hand from the published rules.
CASES = {
    "good": 1.9,
    "very good": 1.9 + 0.293,
    "not good": 1.9 * -0.74,
    "not very good": (1.9 + 0.293) * -0.74,
    "it was GOOD": 1.9 + 0.733,
    "GOOD": 1.9,
    "VERY good day": 1.9 + 0.293 + 0.733,
    "very bad": -2.5 - 0.293,
    "slightly bad": -2.5 + 0.293,
    "very much good": 1.9 + 0.95 * 0.293,
    "no good": 1.9 * -0.74,
    "good but bad": 1.9 * 0.5 - 2.5 * 1.5,
    "never so good": (1.9 + 0.293) * 1.25,
    "without doubt good": 1.9,
    "isn't good": 1.9 * -0.74,
    "least good": 1.9 * -0.74,
    "at least good": 1.9,
    "kind of good": 1.9,
    "it was kind of good": 1.9 - 0.293,
    "it was just enough good": 1.9 - 0.293,
    "now it is the bomb bad": 3.0,
    "that is a bad ass thing": 1.5,
    "(good)": 1.9,
}


def test_token_rules(spark):
    lexicon = spark.createDataFrame(LEXICON, "token string, valence double")
    rows = spark.createDataFrame(list(enumerate(CASES)), "id int, t string")
    sums = polarity.token_valences(rows, "id", "t", lexicon).groupBy("id").agg(F.sum("valence").alias("v"))
    got = {r["id"]: r["v"] for r in sums.collect()}
    for i, (t, expected) in enumerate(CASES.items()):

        assert got[i] == pytest.approx(expected), t


def test_scores_of_whole_texts(spark):
    lexicon = spark.createDataFrame(LEXICON, "token string, valence double")
    rows = spark.createDataFrame([(0, "good day"), (1, "good!!! day??"), (2, ""), (3, "nothing here"), (4, "bad, bad!")], "id int, t string")
    out = {r["id"]: r for r in polarity.polarity(rows, "id", "t", lexicon).collect()}
    assert out[0]["compound"] == pytest.approx(round(1.9 / math.sqrt(1.9**2 + 15), 4))
    assert (out[0]["positive"], out[0]["neutral"]) == (pytest.approx(round(2.9 / 3.9, 3)), pytest.approx(round(1 / 3.9, 3)))
    loud = 1.9 + 3 * 0.292 + 2 * 0.18
    assert out[1]["compound"] == pytest.approx(round(loud / math.sqrt(loud**2 + 15), 4))
    assert tuple(out[2])[1:] == (0.0, 0.0, 0.0, 0.0)
    assert (out[3]["compound"], out[3]["neutral"]) == (0.0, 1.0)
    assert out[4]["compound"] < 0 and out[4]["negative"] == 1.0


def test_idioms_and_emoji_are_parameters(spark):
    lexicon = spark.createDataFrame(LEXICON, "token string, valence double")
    rows = spark.createDataFrame([(0, "so it was plain good"), (1, "😀 day")], "id int, t string")
    out = {r["id"]: r["compound"] for r in polarity.polarity(rows, "id", "t", lexicon, idioms={"plain good": -2.0}, emoji={"😀": "good smile"}).collect()}
    assert out[0] == pytest.approx(round(-2 / math.sqrt(4 + 15), 4))
    assert out[1] == pytest.approx(round(1.9 / math.sqrt(1.9**2 + 15), 4))
