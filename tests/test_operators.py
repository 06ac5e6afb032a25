import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opinara.operators import aggregates, evaluate, joins, limits, prefix, shaping, splits, trends

L = ["negative", "neutral", "positive"]


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize("name,values", [
    ("uniform", np.random.default_rng(1).random(3001)), ("heavy", np.repeat([1.0, 5.0, 7.0], [2000, 1, 999])),
    ("skewed", np.random.default_rng(2).lognormal(0, 3, 2500)), ("one", np.array([4.0])), ("two", np.array([1.0, 2.0])),
])
def test_exact_quantiles(spark, name, values):
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "v": values}))
    out = prefix.exact_quantiles(df, ["k"], ["v"], {"a": 0.25, "b": 0.5, "c": 0.99, "d": 1.0, "e": 0.0}).first()
    assert [out[x] for x in "abcde"] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.99, 1.0, 0.0])))


def test_prefix_sums_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.choice(["hot", "hot", "cold"], 4000), "x": rng.permutation(4000).astype(float), "n": rng.integers(1, 9, 4000)})
    expected = pdf.sort_values("x").assign(b=lambda d: d.groupby("k")["n"].cumsum() - d["n"]).set_index("x")["b"].to_dict()
    for parts in (1, 7):
        out = prefix.with_prefix_sums(spark.createDataFrame(pdf).repartition(parts), ["k"], "x", ["n"], rows_per_range=250).collect()
        assert {r["x"]: r["n_before"] for r in out} == expected
        assert {r["k"]: r["n_total"] for r in out} == pdf.groupby("k")["n"].sum().to_dict()


def test_describe_and_histogram_match_pandas(spark):
    pdf = pd.DataFrame({"v": np.random.default_rng(4).normal(size=500), "w": 3.0})
    df = spark.createDataFrame(pdf)
    got = {r["measure"]: r for r in aggregates.describe(df, ["v", "w"]).collect()}
    expected = pdf.describe()
    for c in ("v", "w"):
        assert [got[c][k] for k in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")] == pytest.approx(list(expected[c]))
    n, edges = np.histogram(pdf["v"], bins=30)
    bins = aggregates.histogram(df, "v", 30).orderBy("bin").collect()
    assert [b["n"] for b in bins] == list(n) and [b["from_value"] for b in bins] == pytest.approx(list(edges[:-1]))
    flat = aggregates.histogram(df, "w", 4).orderBy("bin").collect()
    assert [b["n"] for b in flat] == list(np.histogram(pdf["w"], bins=4)[0])


def test_correlation_of_constant_column_is_null(spark):
    df = rows(spark, [(1.0, 2.0, 1.0), (2.0, 4.0, 1.0), (3.0, 5.0, 1.0), (4.0, None, 1.0)], "a double, b double, c double")
    m = {r["feature"]: r for r in aggregates.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert m["a"]["b"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 5])[0, 1]) and m["a"]["a"] == pytest.approx(1.0)
    assert m["a"]["c"] is None and m["c"]["c"] is None


def test_months_without_rows_are_kept(spark):
    df = rows(spark, [("2024-01-05", 1.0, 1), ("2024-03-31", 3.0, 0), ("2024-03-01", 5.0, 1)], "d string, v double, f int").withColumn("ts", F.to_timestamp("d"))
    out = trends.monthly(df, "ts", {"mean": F.avg("v")}).collect()
    assert [(str(r["month_end"]), r["n"], r["mean"]) for r in out] == [("2024-01-31", 1, 1.0), ("2024-02-29", 0, None), ("2024-03-31", 2, 4.0)]
    shares = trends.monthly_shares(df, "ts", {"pct": "f"}).collect()
    assert [r["pct"] for r in shares] == [100.0, None, 50.0]


def test_trend(spark):
    df = rows(spark, [(2020, 1.0), (2021, 5.0), (2022, 5.0), (2023, 2.0)], "y int, v double")
    r = trends.trend(df, "y", "v").first()
    assert (r["change"], r["direction"], r["best"], r["worst"]) == (1.0, "IMPROVING", 2021, 2020)
    assert trends.trend(df.where("y = 2020"), "y", "v").count() == 0


def test_keep_first_prefers_the_earlier_source(spark):
    a = rows(spark, [(1, "x", "A"), (2, "y", "A"), (3, None, "A")], "seq int, text string, s string")
    b = rows(spark, [(1, "y", "B"), (2, "z", "B"), (3, "z", "B"), (4, None, "B")], "seq int, text string, s string")
    out = shaping.keep_first(shaping.union_all(a, b), ["text"], ["source_rank", "seq"]).collect()
    assert sorted((r["text"] or "", r["s"], r["seq"]) for r in out) == [("", "A", 3), ("x", "A", 1), ("y", "A", 2), ("z", "B", 2)]


def test_keep_first_with_a_hot_text(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    out = shaping.keep_first(df.repartition(5), ["text"], ["id"])
    assert out.count() == 2001 and out.where("text = 'hot'").first()["id"] == 0


def test_group_size_of_missing_key_is_null(spark):
    df = rows(spark, [("a", 1), ("a", 2), (None, 3)], "k string, i int")
    assert {r["i"]: r["community_size"] for r in joins.with_group_size(df, "k").collect()} == {1: 2, 2: 2, 3: None}


def test_cumulative_cap_keeps_the_crossing_row(spark):
    df = rows(spark, [(1, 600), (2, 500), (3, 10), (0, 0)], "o int, n int")
    assert [r["o"] for r in limits.cap_cumulative(df, "o", "n", 1000).orderBy("o").collect()] == [1, 2]


def test_cumulative_cap_with_fractions_and_ranges(spark, monkeypatch):
    df = spark.range(100).select("id", F.lit(0.125).alias("n"))
    assert limits.cap_cumulative(df, "id", "n", 5).count() == 40
    summed = prefix.with_prefix_sums(df.withColumn("k", F.col("id") % 2), ["k"], "id", ["n"], rows_per_range=7)
    assert all(r["n_before"] == r["id"] // 2 * 0.125 and r["n_total"] == 6.25 for r in summed.collect())


def test_keep_first_with_null_and_tied_order(spark):
    df = rows(spark, [("a", None, 1), ("a", 2, 2), ("b", 3, 3), ("b", 3, 4), (None, None, 5), (None, None, 6)], "t string, o int, i int")
    out = shaping.keep_first(df, ["t"], ["o"]).collect()
    assert sorted((r["t"] or "", r["o"] or 0) for r in out) == [("", 0), ("a", 0), ("b", 3)]


def test_rows_a_microsecond_apart_differ(spark):
    df = rows(spark, [("2024-01-01 00:00:00.000001",), ("2024-01-01 00:00:00.000002",)], "s string").select(
        F.col("s").cast("timestamp").alias("a"), F.col("s").cast("timestamp_ntz").alias("b"), F.lit(1).alias("i"))
    assert aggregates.duplicate_rows(df).first()[0] == 0
    for c in ("a", "b"):
        assert shaping.keep_first(df, [c], ["i"]).count() == 2


def test_metadata_is_one_row_per_key(spark):
    comments, posts = rows(spark, [("p", 1), ("p", 2)], "k string, i int"), rows(spark, [("p", "x"), ("p", "y")], "k string, title string")
    assert sorted(tuple(r) for r in joins.with_metadata(comments, posts, "k").collect()) == [("p", 1, "y"), ("p", 2, "y")]


def test_caps_are_pruned_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    capped = limits.cap_per_group(df, ["k"], ["id"], 2)
    assert sorted(r["id"] for r in capped.collect()) == [0, 1, 2, 3, 4, 5]
    assert "WindowGroupLimit" in capped._jdf.queryExecution().executedPlan().toString()


def test_quality_reports(spark):
    df = rows(spark, [(1, None), (1, None), (2, "x"), (3, None)], "a int, b string")
    assert [tuple(r) for r in aggregates.missing_report(df).collect()] == [("b", 3, 75.0), ("a", 0, 0.0)]
    assert aggregates.duplicate_rows(df).first()[0] == 1
    assert aggregates.missing_total(df).first()[0] == 3


def test_split_is_exact_disjoint_and_stable(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 700, "a").when(F.col("id") < 995, "b").otherwise("c").alias("label"))
    out = splits.stratified_split(df, "id", "label", {"test": 0.15, "validation": 0.15})
    counts = {(r["label"], r["split"]): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert counts == {("a", "test"): 105, ("a", "validation"): 105, ("a", "train"): 490, ("b", "test"): 44, ("b", "validation"): 45,
                      ("b", "train"): 206, ("c", "test"): 1, ("c", "validation"): 1, ("c", "train"): 3}
    again = splits.stratified_split(df.repartition(9), "id", "label", {"test": 0.15, "validation": 0.15})
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


def test_class_weights(spark):
    df = rows(spark, [("a",)] * 6 + [("b",)] * 2, "label string")
    assert {r["label"]: r["weight"] for r in splits.class_weights(df, "label").collect()} == {"a": pytest.approx(8 / 12), "b": 2.0}


def predictions(spark):
    data = [("negative", "negative", 0.8, 0.1, 0.1), ("negative", "positive", 0.3, 0.1, 0.6), ("neutral", "positive", 0.2, 0.3, 0.5),
            ("positive", "positive", 0.1, 0.1, 0.8), ("positive", "positive", 0.1, 0.3, 0.6), ("positive", "negative", 0.5, 0.2, 0.3)]
    return rows(spark, data, "actual string, predicted string, prob_negative double, prob_neutral double, prob_positive double")


def test_metrics_with_a_class_never_predicted(spark):
    p = predictions(spark)
    matrix = {r["actual"]: (r["negative"], r["neutral"], r["positive"]) for r in evaluate.confusion_matrix(p, L).collect()}
    assert matrix == {"negative": (1, 0, 1), "neutral": (0, 0, 1), "positive": (1, 0, 2)}
    report = {r["label"]: r for r in evaluate.report(p, L).collect()}
    assert (report["neutral"]["precision"], report["neutral"]["recall"], report["neutral"]["f1"]) == (0.0, 0.0, 0.0)
    assert report["positive"]["precision"] == 0.5 and report["positive"]["recall"] == pytest.approx(2 / 3)
    assert report["macro avg"]["precision"] == pytest.approx((0.5 + 0 + 0.5) / 3)
    assert report["weighted avg"]["recall"] == pytest.approx(0.5) == report["accuracy"]["f1"]


def test_roc_auc_against_all_pairs(spark):
    p = predictions(spark)
    data = [tuple(r) for r in p.collect()]
    areas = []
    for i, label in enumerate(L):
        pos = [r[2 + i] for r in data if r[0] == label]
        neg = [r[2 + i] for r in data if r[0] != label]
        areas.append(np.mean([(x > y) + 0.5 * (x == y) for x in pos for y in neg]))
    probs = {x: f"prob_{x}" for x in L}
    assert evaluate.roc_auc(p, probs).first()[0] == pytest.approx(np.mean(areas))
    assert evaluate.roc_auc(p.where("actual <> 'neutral'"), probs).first()[0] is None


def test_best_group_ties_go_to_the_smallest_key(spark):
    df = rows(spark, [("b", 2.0), ("a", 2.0), ("c", 1.0)], "k string, v double")
    assert aggregates.best_group(df, "k", "v").first()["k"] == "a"
    assert aggregates.best_group(df, "k", "v", largest=False).first()["k"] == "c"


def test_distinct_counts_without_copies_of_rows(spark):
    rows = [(1, "a", 0.0, None), (1, "a", -0.0, None), (2, None, float("nan"), None), (None, "", float("nan"), None)]
    df = spark.createDataFrame(rows, "i int, s string, d double, n string")
    out = aggregates.distinct_counts(df, ["i", "s", "d", "n"])
    assert out.first().asDict() == {"i": 2, "s": 2, "d": 2, "n": 0}
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    assert aggregates.distinct_counts(df.limit(0), ["i", "s"]).first().asDict() == {"i": 0, "s": 0}


def test_cloud_terms(spark):
    from opinara.operators import words

    texts = ["red cats the red cat's cat and glass"] * 20 + [f"word{chr(97 + i)}{chr(97 + j)} x other" for i in range(20) for j in range(9)] + [None, "", "42"]
    df = spark.createDataFrame([("k", x) for x in texts] + [(None, "none")], "label string, text string")
    out = {r["word"]: r["n"] for r in words.cloud_frequencies(df, "label", "text", ["the", "and"], 300).collect()}
    # "red cats" and "red cat" count as one pair and take their words with them, what is left of "cat" stays.
    assert out["red cat"] == 40 and "red" not in out and "cats" not in out and out["cat"] == 20
    assert out["glass"] == 20 and "42" not in out and "the" not in out and out["other"] == 180
