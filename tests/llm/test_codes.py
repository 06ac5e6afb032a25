from collections import defaultdict
from math import floor

import numpy as np
import pytest

from opinara.llm import codes


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """(id, label, code, error) of every row and the entries, all distances taken."""
    rows = [(i, [floor(scale * c) for c in v], label) for i, v, label in rows]
    bounds = codes.cuts(len(rows[0][1]), parts)
    first = {}
    for i, v, _ in rows:
        if i is not None:
            first[i] = min(v, first.get(i, v))
    books = [[first[i][a:b] for i in sorted(first)[:entries]] for a, b in zip(bounds, bounds[1:])]

    def assign():
        out = []
        for _, v, _ in rows:
            found = [min((sum((x - y) ** 2 for x, y in zip(v[a:b], e)), k) for k, e in enumerate(book))
                     for (a, b), book in zip(zip(bounds, bounds[1:]), books)]
            out.append(found)
        return out

    for _ in range(rounds):
        held = defaultdict(list)
        for (_, v, _), found in zip(rows, assign()):
            for k, (_, e) in enumerate(found):
                held[k, e].append(v[bounds[k]:bounds[k + 1]])
        for (k, e), vs in held.items():
            books[k][e] = [sum(col) // len(vs) for col in zip(*vs)]
    found = assign()
    out = [(i, label, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for (i, _, label), f in zip(rows, found)]
    return out, books


def clustered(n, width, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(9, width))
    return (middle[rng.integers(0, 9, n)] + 0.05 * rng.normal(size=(n, width))).astype("float32")


@pytest.mark.parametrize("width, parts, entries, spread", [(8, 4, 16, True), (6, 4, 7, False), (4, 1, 30, True)])
def test_codes_against_all_distances(spark, width, parts, entries, spread):
    x = clustered(300, width) if spread else np.random.default_rng(3).integers(-3, 4, (300, width)) / 1024
    rows = [(i * 7 % 300, [float(v) for v in r], i % 5 or None) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    out = codes.encode(df, parts=parts, entries=entries, block=64).collect()
    expected, books = brute(rows, parts, entries)
    assert sorted((r["vec_id"], r["label"] or 0, r["code"], r["error"]) for r in out) == sorted((i, n or 0, c, e) for i, n, c, e in expected)
    assert {r["codebooks_sha256"] for r in out} == {codes.digest([np.array(b) for b in books])}
    by = defaultdict(int)
    for _, n, _, e in expected:
        by[n] += e
    assert all(r["label_error"] == by[r["label"]] for r in out)


@pytest.mark.parametrize("leaf", [1, 4, 32])
def test_trees_hold_every_point_once(leaf):
    rows = floor_of(clustered(500, 5, 2))
    tree = codes.grown(np.concatenate((rows, rows[:50])), leaf)
    assert (tree.points[tree.place] == np.concatenate((rows, rows[:50]))).all() and tree.weights.sum() == 550
    assert tree.counts[0] == 550 and (tree.sums[0] == rows.sum(axis=0) + rows[:50].sum(axis=0)).all()
    for k in range(len(tree.low)):
        inside = tree.points[tree.low[k]:tree.high[k]]
        assert np.linalg.norm(inside - tree.centres[k], axis=1).max() <= tree.radii[k] + 1e-6
        if tree.left[k] >= 0:
            a, b = tree.left[k], tree.right[k]
            assert (tree.low[a], tree.high[a], tree.high[b]) == (tree.low[k], tree.low[b], tree.high[k])
            assert tree.counts[a] + tree.counts[b] == tree.counts[k] and (tree.sums[a] + tree.sums[b] == tree.sums[k]).all()


def floor_of(x):
    return np.floor(x.astype("float64") * 1024).astype("int64")


def test_balls_are_owned_and_lists_shrink():
    rows = floor_of(clustered(2000, 4, 4))
    tree, entries = codes.grown(rows), floor_of(clustered(40, 4, 5))
    seen = {"owned": 0, "asked": 0, "pairs": 0}

    def owned(ball, entry):
        seen["owned"] += tree.high[ball] - tree.low[ball]

    def asked(ball, left, distances):
        seen["asked"] += distances.shape[0]
        seen["pairs"] += distances.size

    codes.walk(tree, entries, owned, asked)
    assert seen["owned"] + seen["asked"] == len(tree.points) and seen["owned"] > 0
    assert seen["pairs"] < 0.5 * len(tree.points) * len(entries)
    code, error = codes.nearest(tree, entries)
    all_ = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (code == all_.argmin(axis=1)).all() and (error == all_.min(axis=1)).all()


def test_large_entries_stay_exact():
    rows = np.array([[2**25, -(2**25), 1], [2**25 - 1, -(2**25), 0]])
    assert codes.squared(rows, rows).tolist() == [[0, 2], [2, 0]]
    far = codes.squared(np.full((1, 4), 2**25), np.full((1, 4), -(2**25)))
    assert far.tolist() == [[4 * 2**52]]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[float(v) for v in r] for r in clustered(30, 8, 6)]
    rows = [(i, r, i % 2, "x") for i, r in enumerate(good)] + [
        (0, good[3], 1, "x"), (5, good[5], 1, "x"), (None, good[4], None, None), (40, None, 1, "x"), (41, [], 1, "x"), (42, [1.0] * 7 + [None], 1, "x"),
        (43, [nan] * 8, 1, "x"), (44, [1.0] * 7 + [inf], 1, "x"), (45, [1.0] * 4, 1, "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, code string")
    out = codes.encode(df).collect()
    kept = [(i, v, label) for i, v, label, _ in rows if i is None or i < 40]
    expected, books = brute(kept)
    assert sorted(map(str, ((r["vec_id"], r["label"], r["code"], r["error"]) for r in out))) == sorted(map(str, expected))
    assert {r["codebooks_sha256"] for r in out} == {codes.digest([np.array(b) for b in books])}
    assert codes.encode(df.limit(0)).collect() == [] and codes.encode(df.where("vec_id = 43")).collect() == []
    alone = codes.encode(df.where("vec_id IS NULL")).collect()
    assert [(r["vec_id"], r["code"], r["error"]) for r in alone] == [(None, "00000000", 0)]
