from fractions import Fraction
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.llm import whitening


def vectors(n, width, seed=1):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, width)) @ rng.normal(size=(width, width)) + rng.normal(size=width)
    return [[float(np.float32(x)) for x in row] for row in mixed]


def exact_covariance(rows):
    """By fractions, centred before multiplying."""
    x = [[floor(64 * c) + 1_000_000 for c in row] for row in rows]
    n, width = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(width)]
    y = [[n * r[i] - sums[i] for i in range(width)] for r in x]
    cov = [[Fraction(sum(r[a] * r[b] for r in y), n**3) for b in range(width)] for a in range(width)]
    return cov, [sum(v * v for v in r) for r in y], x, sums


def test_all_rows_against_fractions(spark):
    rows = vectors(90, 6)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "vec_id bigint, embedding array<float>").repartition(5)
    out = whitening.whiten(df, components=4).collect()
    cov, deviation, x, sums = exact_covariance(rows)
    model = whitening.fit(df)
    assert [[float(c) for c in row] for row in cov] == model.covariance.tolist()
    values, axes = np.linalg.eigh(model.covariance)
    assert len(out) == 90 * 4 and {r["n"] for r in out} == {90}
    for r in out:
        i, k = r["vec_id"], r["component"]
        assert r["deviation"] == deviation[i]
        centred = np.array([float(Fraction(v) - Fraction(s, 90)) for v, s in zip(x[i], sums)])
        expected = centred @ axes[:, -k] / np.sqrt(values[-k])
        assert abs(r["whitened"]) == pytest.approx(abs(expected), rel=1e-9, abs=1e-9)
        assert r["explained"] == pytest.approx(values[-k] / values.sum(), rel=1e-9)
        assert r["identity_error"] < 1e-9
    z = np.array([[r["whitened"] for r in sorted(out, key=lambda r: r["vec_id"]) if r["component"] == k] for k in range(1, 5)])
    assert np.abs(np.cov(z, bias=True) - np.eye(4)).max() < 1e-9


def test_sums_beyond_a_long():
    big = np.array([[2**40, -(2**40)], [3, 5]], dtype="int64")
    first, second = whitening.squares(big)
    assert list(first) == [2**80 + 9, 64] and list(second) == [2**80 + 25]


def test_large_entries(spark):
    rows = [[1e300, 0.5], [-1e300, 0.25], [2.0, 7.0]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "vec_id bigint, embedding array<double>")
    out = whitening.whiten(df).collect()
    assert len(out) == 6 and all(r["deviation"] is None or r["deviation"] >= 0 for r in out)
    assert {r["deviation"] is None for r in out if r["vec_id"] == 0} == {True}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = vectors(20, 3, 2)
    rows = [(i, r, "x") for i, r in enumerate(good)] + [(i, r, "x") for i, r in enumerate(good[:5])] + [
        (None, good[0], None), (30, None, "x"), (31, [], "x"), (32, [1.0, None, 2.0], "x"), (33, [nan, 1.0, 2.0], "x"),
        (34, [1.0, inf, 2.0], "x"), (35, [1.0, 2.0], "x"), (36, [-inf, 0.0, 0.0], "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, whitened string")
    out = whitening.whiten(df).collect()
    assert {r["vec_id"] for r in out} == {None, *range(20)} and len(out) == 26 * 3 and {r["n"] for r in out} == {26}
    assert max(r["identity_error"] for r in out) < 1e-9
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(df.where("vec_id = 32")).collect() == []


def test_without_variance(spark):
    df = spark.range(7).select(F.col("id").alias("vec_id"), F.array(F.lit(0.5), F.col("id") / 4, F.lit(3.0)).alias("embedding"))
    out = whitening.whiten(df).collect()
    assert {(r["component"], r["whitened"] is None) for r in out} == {(1, False), (2, True), (3, True)}
    assert max(r["identity_error"] for r in out) < 1e-9
    one = whitening.whiten(df.limit(1)).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in one] == [(None, None, None, 0)] * 3


def test_a_model_of_other_rows(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(vectors(60, 4, 5))], "vec_id bigint, embedding array<float>")
    model = whitening.fit(df.where("vec_id < 40"))
    again = whitening.whiten(df, model=model).collect()
    alone = whitening.whiten(df.where("vec_id < 40")).collect()
    mine = {(r["vec_id"], r["component"]): r["whitened"] for r in again}
    assert len(mine) == 60 * 4 and all(mine[r["vec_id"], r["component"]] == pytest.approx(r["whitened"]) for r in alone)
