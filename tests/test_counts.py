import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opinara.operators import counts, models, terms, words

TEXTS = [
    "The red cat's tail, the red cats", "red_tail 42 red tail\nRED", "Été à l'été — “été” naïve x", "a 'b c'd don't ' ''", None, "",
    "日本語 テキスト ½ ٣٤ the 日本語", "red the red", "tail red tail red", "x" * 50 + " red tail",
]


def expected(texts, stop, across):
    found = Counter()
    for t in filter(None, texts):
        single = [w for w in re.findall(r"\w{2,}", t.lower()) if across or w not in stop]
        found.update((w, None) for w in single if w not in stop)
        found.update((a, b) for a, b in zip(single, single[1:]) if a not in stop and b not in stop)
    return found


@pytest.mark.parametrize("across", [False, True])
@pytest.mark.parametrize("size", [1, 1 << 20])
def test_counts_are_those_of_words_one_by_one(spark, monkeypatch, across, size):
    monkeypatch.setattr(counts.slices, "__defaults__", (size,))
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3)
    out = counts.counted(df, F.lower("text"), None, ["the"], pairs=True, across=across).groupBy("first", "second").agg(F.sum("n").alias("n"))
    assert {(r["first"], r["second"]): r["n"] for r in out.collect()} == expected(TEXTS, ["the"], across)


def test_pairs_among_given_words(spark):
    df = spark.createDataFrame([(i % 2, t) for i, t in enumerate(TEXTS)] + [(None, "red tail")], "g int, text string").repartition(3)
    rows = counts.counted_among(df, F.lower("text"), ["red", "tail", "absent"], "g", ["the"]).collect()
    for g in (0, 1):
        wanted = {k: n for k, n in expected(TEXTS[g::2], ["the"], False).items() if k[1] and set(k) <= {"red", "tail"}}
        assert {(r["first"], r["second"]): r["n"] for r in rows if r["_by"] == g} == wanted
    assert [(r["first"], r["second"], r["n"], r["n_docs"]) for r in rows if r["_by"] is None] == [("red", "tail", 1, 1)]


def test_runs_count_texts_once_also_where_numbers_are_large():
    keys, docs = np.array([5, 5, 3, 5, 3]), np.array([0, 0, 0, 1, 2])
    for add in (0, 2**62):
        found, n, n_docs = counts.runs(keys + add, docs)
        assert found.tolist() == [3 + add, 5 + add] and n.tolist() == [2, 3] and n_docs.tolist() == [2, 2]
    assert [len(x) for x in counts.runs(keys[:0], docs[:0])] == [0, 0, 0]
    assert list(counts.slices(pa.array(["aaa", None, "b", "cc"]), 3)) == [(0, 2), (2, 4)]


@pytest.mark.parametrize("ties", [0, 4])
def test_only_frequent_words_make_counted_pairs(spark, monkeypatch, ties):
    """Pairs of words too rare to be kept were all counted before; leaving them out changes no vocabulary."""
    monkeypatch.setattr(counts, "TIES", ties)
    texts = ["big apple pie", "big apple pie", "big apple tree", "rare odd words", "other odd thing", "pie big"]
    df = spark.createDataFrame([("k", t) for t in texts], "label string, text string")
    stats = terms.term_statistics(df, "text").select(F.lit(None).cast("string").alias("_by"), "term", "n", F.lit(True).alias("eligible"))
    assert counts.frequent(stats, 3) == (None if ties == 0 else pytest.approx(counts.frequent(stats, 3)))
    if ties:
        assert set(counts.frequent(stats, 3)) == {"big", "apple", "pie"} and counts.frequent(stats, 99) is None
    whole = Counter()
    for t in texts:
        w = t.split()
        whole.update([*w, *map(" ".join, zip(w, w[1:]))])
    best = sorted(whole.items(), key=lambda x: (-x[1], x[0]))
    for k in (1, 3, 4, 5, 40):
        assert {r["term"]: r["n"] for r in terms.vocabulary(df, "text", k).collect()} == dict(best[:k])
        out = words.word_frequencies(df, "label", "text", [], k, pairs=True).collect()
        assert [(r["word"], r["n"]) for r in sorted(out, key=lambda r: r["rank"])] == best[:k]

def test_forest_keeps_the_nodes_of_rows():
    """Without, every pass sends all trees and walks them from the root."""
    assert models._estimator("random_forest", {"max_depth": 5}, 10, None).getCacheNodeIds()
