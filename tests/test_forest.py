"""The forest against exhaustive search, its draws, its counts, and the model it gives."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from opinara.operators import forest, models


def gini(y, w, classes=3):
    parts = np.bincount(y, w, classes)
    return 1 - ((parts / parts.sum()) ** 2).sum() if parts.sum() else 1.0


def table(n=90, n_features=8, seed=3):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        values = {j: rng.choice([1.0, 2.0, -1.5, 0.5]) for j in range(n_features) if rng.random() < 0.3}
        rows.append(("a" if values.get(3, 0) > 0.7 else "b" if values.get(5, 0) < 0 else "c", values))
    return rows


def batch(rows, n_trees, classes="abc"):
    """A batch as ``_start`` gives it, without drawing rows: all are in the root of every tree."""
    ends = np.full((8, 31), np.inf)
    ends[:, :4] = [-1.5, 0.0, 0.5, 1.0]
    values = [sorted(v.items()) for _, v in rows]
    flat = [x for line in values for x in line]
    at = np.concatenate([[0], np.cumsum([len(line) for line in values])])
    indices = np.array([i for i, _ in flat], np.int32)
    bins = np.array([(x > ends[i]).sum() for i, x in flat], np.uint8)
    every = np.arange(len(rows) + 1) * n_trees
    y = np.array([classes.index(label) for label, _ in rows], np.int32)
    columns = [forest._binary(indices, at), forest._binary(bins, at), forest._binary(np.ones(len(rows) * n_trees, np.uint8), every),
               forest._binary(np.zeros(len(rows) * n_trees, np.int32), every), pa.array(y), pa.array(1.0 + y)]
    return pa.RecordBatch.from_arrays(columns, names=["indices", "bins", "drawn", "nodes", "y", "w"]), ends, y


@pytest.mark.parametrize("least", [1, 12])
def test_best_split_is_that_of_a_search_over_all_rows(least):
    rows = table()
    made, ends, y = batch(rows, 6)
    zero_bin = (ends < 0).sum(axis=1)
    sums, = forest._sums(6, 0, 7, 8, 3, 32, 3)([made])
    found = forest._splits(*[c.to_numpy() for c in sums.columns], zero_bin, 32, 3, least)
    x = np.array([[v.get(j, 0.0) for j in range(8)] for _, v in rows])
    w = 1.0 + y
    for tree, _, feature, end, gain, total_w, total_n, left_w, left_n in zip(*found):
        drawn = forest.drawn_features(7, int(tree), 0, np.array([0]), 8, 3)[0]
        best = 0.0
        for j in drawn:
            for cut in ends[j][np.isfinite(ends[j])]:
                left = x[:, j] <= cut
                if min(left.sum(), (~left).sum()) >= least:
                    share = w[left].sum() / w.sum()
                    best = max(best, gini(y, w) - share * gini(y[left], w[left]) - (1 - share) * gini(y[~left], w[~left]))
        assert gain == pytest.approx(best) and feature in drawn
        left = x[:, feature] <= ends[feature, end]
        assert left_n.tolist() == np.bincount(y[left], minlength=3).tolist() and total_n.tolist() == np.bincount(y, minlength=3).tolist()
        assert left_w == pytest.approx(np.bincount(y[left], w[left], 3)) and total_w == pytest.approx(np.bincount(y, w, 3))


def test_counts_follow_the_values_rows_have_not_nodes_and_bins():
    """Each row in a node of its own: 90 nodes of 3 features with 32 bins and 3 classes would be 25,920 counts a tree."""
    made, _, _ = batch(table(), 2)
    alone = np.repeat(np.arange(90, dtype=np.int32), 2)
    columns = [*made.columns[:3], forest._binary(alone, np.arange(91) * 2), *made.columns[4:]]
    sums, = forest._sums(2, 5, 7, 8, 3, 32, 3)([pa.RecordBatch.from_arrays(columns, names=made.schema.names)])
    assert len(sums) <= 2 * (90 + sum(len(v) for _, v in table()))


def test_drawn_features_differ_and_are_the_same_in_every_task():
    nodes = np.arange(500)
    drawn = forest.drawn_features(42, 3, 4, nodes, 30, 6)
    assert all(len(set(line)) == 6 for line in drawn.tolist()) and drawn.min() >= 0 and drawn.max() < 30
    assert (forest.drawn_features(42, 3, 4, nodes[100:200], 30, 6) == drawn[100:200]).all()
    assert 70 <= np.bincount(drawn.ravel(), minlength=30).min() and np.bincount(drawn.ravel()).max() <= 130
    assert (forest.drawn_features(42, 4, 4, nodes, 30, 6) != drawn).any()


def test_rows_are_drawn_with_replacement():
    drawn = forest.times_drawn(42, np.arange(20_000), 5)
    assert (forest.times_drawn(42, np.arange(500, 900), 5) == drawn[500:900]).all() and (forest.times_drawn(43, np.arange(20_000), 5) != drawn).any()
    for k, share in enumerate((0.3679, 0.3679, 0.1839, 0.0613)):
        assert (drawn == k).mean(axis=0) == pytest.approx([share] * 5, abs=0.012)
    assert abs(np.corrcoef(drawn.T) - np.eye(5)).max() < 0.03


def test_model_is_that_of_its_rows(spark):
    """Dense and sparse vectors, negative values: leaves hold their rows, and sum up to the root."""
    rows = table(300)
    kinds = [Vectors.sparse(8, v) if i % 2 else Vectors.dense([v.get(j, 0.0) for j in range(8)]) for i, (_, v) in enumerate(rows)]
    df = spark.createDataFrame([(k, label) for k, (label, _) in zip(kinds, rows)], ["features", "label"]).repartition(3)
    params = {"n_estimators": 8, "max_depth": 6, "min_samples_leaf": 4, "class_weight": "balanced"}
    fitted = models.fit(df, "random_forest", ["a", "b", "c"], "label", params)
    right = models.predict(fitted, df, ["label"]).agg(F.avg((F.col("label") == F.col("predicted")).cast("double"))).first()[0]
    model = fitted.classifier
    assert right > 0.95 and len(model.trees) == 8 and max(t.depth for t in model.trees) <= 6 and model.numClasses == 3
    assert set(np.argsort(model.featureImportances.toArray())[-2:]) == {3, 5}
    path = f"{spark.conf.get('spark.sql.warehouse.dir')}/forest-test"
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    leaves = nodes.where("leftChild < 0").groupBy("treeID").agg(F.min("rawCount").alias("least"), F.sum("rawCount").alias("n"))
    for r in leaves.join(nodes.where("id = 0").select("treeID", "rawCount"), "treeID").collect():
        assert r["least"] >= 4 and r["n"] == r["rawCount"]
