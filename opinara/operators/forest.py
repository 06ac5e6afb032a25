"""A random forest whose counts are kept only where rows have values.

Spark ML's trainer fills counts for every bin of every drawn feature of every node in every task, so its work grows as
nodes times tasks, and nodes grow with rows. Texts have a few of the drawn features each. Here a row adds to the bins of the
values it has; what zeros add up to is the total of the node less those. All trees grow by one level at a time:

1. tasks sum weights by tree, node, drawn feature, bin and class over their rows, and Spark adds these sums up;
2. the best split of each node is found where its sums meet;
3. rows move to the child of their node in each tree.

As in Spark ML: rows are drawn with replacement for each tree (Poisson), each node draws its own features, Gini impurity with row
weights, splits at bin ends, values up to the threshold go left, leaves that say the same as their sibling are merged. Bins
differ: zero has one, the others hold equal shares of the other values, by approximate quantiles of all rows. Draws differ, too.

The result is Spark ML's model, read from its saved form. The driver gets the splits of one level, and the model in the end.
"""

from __future__ import annotations

import json
import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.operators.sizing import measured
from opinara.session import scratch_path

#: Relative error of the quantiles that bound bins is at most one in this.
QUANTILE_ACCURACY = 1000
_STATE = "indices binary, bins binary, drawn binary, nodes binary, y int, w double"
_CELLS = "tree int, node int, cell long, w double, n long"
_SPLITS = "tree int, node int, feature int, bin int, gain double, w array<double>, n array<bigint>, left_w array<double>, left_n array<bigint>"
_NODE = ("id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, leftChild int, "
         "rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>")


def _flat(column, dtype):
    """Numbers of a binary or list column without nulls, one after the other, and where each row's begin."""
    import numpy as np
    import pyarrow as pa

    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    size = np.dtype(dtype).itemsize
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset) if len(column) else np.zeros(1, np.int32)
    data = column.buffers()[2]
    values = np.frombuffer(data, dtype, (at[-1] - at[0]) // size, at[0]) if data is not None and at[-1] > at[0] else np.zeros(0, dtype)
    return values, (at - at[0]) // size


def _binary(values, starts):
    """A binary column of numbers that begin at ``starts`` for each row."""
    import numpy as np
    import pyarrow as pa

    offsets = (np.asarray(starts, np.int64) * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _entries(vectors):
    """Row, feature and value of what is not zero in a column of vectors, and where each row's begin."""
    import numpy as np

    kind = vectors.field("type").to_numpy()
    values, at = _flat(vectors.field("values").fill_null([]), np.float64)
    indices, indices_at = _flat(vectors.field("indices").fill_null([]), np.int32)
    row = np.repeat(np.arange(len(kind)), np.diff(at))
    feature = np.arange(len(values)) - at[row]
    sparse = kind[row] == 0
    feature[sparse] = indices[(indices_at[row] + feature)[sparse]]
    real = values != 0
    row, feature, values = row[real], feature[real].astype(np.int32), values[real]
    return row, feature, values, np.searchsorted(row, np.arange(len(kind) + 1))


def cut_points(rows: DataFrame, n_features: int, bins: int):
    """Upper ends of the bins of each feature, ascending and filled up with infinity: one line per feature."""
    import numpy as np

    def values(batches):
        import pyarrow as pa

        for batch in batches:
            _, feature, value, _ = _entries(batch.column(0))
            yield pa.RecordBatch.from_pydict({"feature": feature, "value": value})

    shares = [i / (bins - 2) for i in range(1, bins - 2)] if bins > 3 else [0.5]
    found = rows.select("features").mapInArrow(values, "feature int, value double").groupBy("feature").agg(
        F.percentile_approx("value", shares, QUANTILE_ACCURACY).alias("ends"), F.max("value").alias("most"),
        F.max(F.when(F.col("value") < 0, F.col("value"))).alias("below"),
    )
    cuts = np.full((n_features, bins - 1), np.inf)
    for feature, ends, most, below in found.collect():
        ends = {x for x in ends if x < most} | ({0.0} if most > 0 else set()) | ({below} if below is not None else set())
        line = sorted(ends)[: bins - 1]
        cuts[feature, : len(line)] = line
    return cuts


def _mixed(x):
    """Numbers that look drawn at random, one for each input."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn_features(seed: int, tree: int, level: int, nodes, n_features: int, n_drawn: int):
    """``n_drawn`` different features for each node, the same whichever task asks."""
    import numpy as np

    if n_drawn >= n_features:
        return np.broadcast_to(np.arange(n_features), (len(nodes), n_features))
    root = _mixed(np.array([seed % 2**64, tree + 1, level + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    base = _mixed(np.asarray(nodes, np.uint64) ^ root[0] ^ (root[1] << np.uint64(1)) ^ (root[2] << np.uint64(2)))
    place = np.arange(1, n_drawn + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    drawn = (_mixed(base[:, None] + place) % np.uint64(n_features)).astype(np.int64)
    again, turn = np.arange(len(nodes)), 0
    while len(again):
        order = np.argsort(drawn[again], axis=1, kind="stable")
        ranked = np.take_along_axis(drawn[again], order, 1)
        line, at = np.nonzero(ranked[:, 1:] == ranked[:, :-1])
        if not len(line):
            break
        turn += 1
        which, where = again[line], order[line, at + 1]
        drawn[which, where] = _mixed(_mixed(base[which] + np.uint64(turn)) + place[where]) % np.uint64(n_features)
        again = np.unique(which)
    return drawn


def times_drawn(seed: int, rows, n_trees: int):
    """How often each tree has drawn each row, by the row's number: shares of a Poisson distribution with mean 1."""
    import numpy as np

    shares = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
    root = _mixed(np.array([seed % 2**64], np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))
    base = _mixed(_mixed(np.asarray(rows).astype(np.uint64)) ^ root)
    place = np.arange(1, n_trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.searchsorted(shares, _mixed(base[:, None] + place) / 2.0**64, side="right").astype(np.uint8)


def _gini(weights):
    import numpy as np

    total = weights.sum(axis=1)
    return 1 - ((weights / np.where(total > 0, total, 1)[:, None]) ** 2).sum(axis=1)


def _splits(tree, node, cell, w, n, zero_bin, bins, classes, least):
    """The best split of each node from its sums; feature -1 where none lowers the impurity."""
    import numpy as np

    group, at = np.unique(tree.astype(np.int64) << 32 | node, return_inverse=True)
    total_w, total_n = np.zeros((len(group), classes)), np.zeros((len(group), classes), np.int64)
    whole = cell < 0
    total_w[at[whole], -1 - cell[whole]] = w[whole]
    total_n[at[whole], -1 - cell[whole]] = n[whole]
    at, cell, w, n = at[~whole], cell[~whole], w[~whole], n[~whole]
    n_features = len(zero_bin)
    line, row = np.unique((at * n_features + cell // (bins * classes)) * bins + cell // classes % bins, return_inverse=True)
    sum_w, sum_n = np.zeros((len(line), classes)), np.zeros((len(line), classes), np.int64)
    sum_w[row, cell % classes], sum_n[row, cell % classes] = w, n
    # What is left of a node's total has a zero in this feature.
    pair, first = np.unique(line // bins, return_index=True)
    if len(pair):
        rest_w = total_w[pair // n_features] - np.add.reduceat(sum_w, first)
        rest_n = total_n[pair // n_features] - np.add.reduceat(sum_n, first)
        line, row = np.unique(np.concatenate([line, pair * bins + zero_bin[pair % n_features]]), return_inverse=True)
        w2, n2 = np.zeros((len(line), classes)), np.zeros((len(line), classes), np.int64)
        np.add.at(w2, row, np.concatenate([sum_w, np.where(rest_n > 0, rest_w, 0)]))
        np.add.at(n2, row, np.concatenate([sum_n, rest_n]))
        _, first, lines = np.unique(line // bins, return_index=True, return_counts=True)
        left_w, left_n = np.cumsum(w2, axis=0), np.cumsum(n2, axis=0)
        left_w -= np.repeat((left_w - w2)[first], lines, axis=0)
        left_n -= np.repeat((left_n - n2)[first], lines, axis=0)
    else:
        left_w, left_n = np.zeros((0, classes)), np.zeros((0, classes), np.int64)
    left_w = np.where(left_n > 0, left_w, 0)
    at = line // bins // n_features
    right_n = total_n[at] - left_n
    right_w = np.where(right_n > 0, total_w[at] - left_w, 0)
    whole = total_w.sum(axis=1)
    share = left_w.sum(axis=1) / whole[at]
    gain = _gini(total_w)[at] - share * _gini(left_w) - (1 - share) * _gini(right_w)
    fits = (left_n.sum(axis=1) >= least) & (right_n.sum(axis=1) >= least) & (gain > 1e-12)
    order = np.lexsort((line, -gain, at))
    order = order[fits[order]]
    found, first = np.unique(at[order], return_index=True)
    best = np.full(len(group), -1)
    best[found] = order[first]
    some = best >= 0
    pick = lambda values: np.where(some[:, None], values[best], 0) if len(values) else np.zeros((len(group), classes), values.dtype)
    feature, bin_, gained = (np.full(len(group), x, t) for x, t in ((-1, np.int32), (-1, np.int32), (-1.0, np.float64)))
    feature[some], bin_[some], gained[some] = (line // bins % n_features)[best[some]], (line % bins)[best[some]], gain[best[some]]
    return group >> 32, group & 0xFFFFFFFF, feature, bin_, gained, total_w, total_n, pick(left_w), pick(left_n)


def open_children(feature, n, left_n, least: int, level: int, max_depth: int):
    """For each node of a level, in order: may its left child, and its right one, be split further?"""
    def mixed(counts):
        return (feature >= 0) & ((counts > 0).sum(axis=1) > 1) & (counts.sum(axis=1) >= 2 * least) & (level + 1 < max_depth)

    return mixed(left_n), mixed(n - left_n)


def _numbered(left, right):
    """Numbers of open children in the next level, from 0, by parent and left before right; -1 for others."""
    import numpy as np

    both = np.stack([left, right], axis=1).ravel()
    return np.where(both, np.cumsum(both) - 1, -1).reshape(-1, 2)


def _lists(rows):
    import numpy as np
    import pyarrow as pa

    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))


def _matrix(column, width):
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _start(n_trees: int, cuts, seed: int):
    """Rows as indices and bins of their values, how often each tree has drawn them, and the root as their node."""
    def make(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            size = len(batch)
            if not size:
                continue
            _, feature, value, at = _entries(batch.column(0))
            bins = np.zeros(len(value), np.uint8)
            for end in range(cuts.value.shape[1]):
                bins += value > cuts.value[feature, end]
            drawn = times_drawn(seed, batch.column(3).to_numpy(), n_trees)
            nodes = np.where(drawn > 0, 0, -1).astype(np.int32)
            every = np.arange(size + 1) * n_trees
            yield pa.RecordBatch.from_arrays(
                [_binary(feature, at), _binary(bins, at), _binary(drawn.ravel(), every), _binary(nodes.ravel(), every),
                 batch.column(1).cast(pa.int32()), batch.column(2).cast(pa.float64())],
                names=["indices", "bins", "drawn", "nodes", "y", "w"])

    return make


def _sums(n_trees: int, level: int, seed: int, n_features: int, n_drawn: int, bins: int, classes: int):
    """Weights and rows of a batch by tree, node and class, and by drawn feature and bin where rows have values."""
    def make(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            size = len(batch)
            if not size:
                continue
            indices, at = _flat(batch.column(0), np.int32)
            bin_ = _flat(batch.column(1), np.uint8)[0]
            drawn = _flat(batch.column(2), np.uint8)[0].reshape(size, n_trees)
            nodes = _flat(batch.column(3), np.int32)[0].reshape(size, n_trees)
            y, weight = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            row, indices = np.repeat(np.arange(size), np.diff(at)), indices.astype(np.int64)
            cell = (indices * bins + bin_) * classes + y[row]
            parts = []
            for tree in range(n_trees):
                inside = np.flatnonzero(nodes[:, tree] >= 0)
                if not len(inside):
                    continue
                present, place = np.unique(nodes[inside, tree], return_inverse=True)
                wanted = np.zeros((len(present) + 1, n_features), bool)
                wanted[np.arange(len(present))[:, None], drawn_features(seed, tree, level, present, n_features, n_drawn)] = True
                slot = np.full(size, len(present))
                slot[inside] = place
                at_feature = (slot * n_features)[row]
                at_feature += indices
                hit = np.flatnonzero(wanted.ravel()[at_feature])
                who = np.concatenate([inside, row[hit]])
                of = slot[who]
                what = np.concatenate([-1 - y[inside], cell[hit]]) + classes
                key, where = np.unique(of * (n_features * bins * classes + classes) + what, return_inverse=True)
                times = drawn[who, tree].astype(np.float64)
                of, what = np.divmod(key, n_features * bins * classes + classes)
                parts.append((np.full(len(key), tree, np.int32), present[of], what - classes,
                              np.bincount(where, times * weight[who], len(key)), np.bincount(where, times, len(key)).astype(np.int64)))
            if parts:
                names = ["tree", "node", "cell", "w", "n"]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], names=names)

    return make


def _best(zero_bin, bins: int, classes: int, least: int):
    """Splits of the nodes whose sums a task holds. They come by tree and node, so a node is complete when the next begins."""
    def make(batches):
        import numpy as np
        import pyarrow as pa

        def told(parts):
            found = _splits(*parts, zero_bin, bins, classes, least)
            names = ["tree", "node", "feature", "bin", "gain", "w", "n", "left_w", "left_n"]
            kinds = [pa.int32()] * 4 + [pa.float64()] + [None] * 4
            columns = [pa.array(x, k) if k else _lists(x) for x, k in zip(found, kinds)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        kept = None
        for batch in batches:
            if not len(batch):
                continue
            now = [c.to_numpy() for c in batch.columns]
            now = now if kept is None else [np.concatenate(x) for x in zip(kept, now)]
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            done = last[-1] + 1 if len(last) else 0
            if done:
                yield told([x[:done] for x in now])
            kept = [x[done:] for x in now]
        if kept is not None:
            yield told(kept)

    return make


def _moved(n_trees: int, n_features: int, splits, zero_bin):
    """Rows with the node of the next level that they belong to in each tree, -1 where that is a leaf."""
    def make(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            size = len(batch)
            if not size:
                continue
            indices, at = _flat(batch.column(0), np.int32)
            bin_ = _flat(batch.column(1), np.uint8)[0]
            nodes = _flat(batch.column(3), np.int32)[0].reshape(size, n_trees).copy()
            place = np.repeat(np.arange(size, dtype=np.int64), np.diff(at)) * n_features + indices
            for tree in range(n_trees):
                inside = np.flatnonzero(nodes[:, tree] >= 0)
                if not len(inside):
                    continue
                feature, end, children = splits.value[tree]
                node = nodes[inside, tree]
                split = feature[node] >= 0
                of = np.where(split, feature[node], 0)
                wanted = inside * n_features + of
                found = np.minimum(np.searchsorted(place, wanted), max(len(place) - 1, 0))
                held = place[found] == wanted if len(place) else np.zeros(len(wanted), bool)
                own = np.where(held, bin_[found] if len(place) else 0, zero_bin[of])
                nodes[inside, tree] = np.where(split, children[node, (own > end[node]).astype(np.int8)], -1)
            every = np.arange(size + 1) * n_trees
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _binary(nodes.ravel(), every), *batch.columns[4:]], names=batch.schema.names)

    return make


def _tree_nodes(cuts, classes: int, least: int, max_depth: int):
    """One tree's nodes from the splits of its levels, numbered by level, leaves that agree with their sibling merged."""
    def make(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by([("level", "ascending"), ("node", "ascending")]).combine_chunks()
        level, feature, end = (table[x].to_numpy() for x in ("level", "feature", "bin"))
        gain = table["gain"].to_numpy()
        w, n, left_w, left_n = (_matrix(table[x].combine_chunks(), classes) for x in ("w", "n", "left_w", "left_n"))
        right_n = n - left_n
        right_w = np.where(right_n > 0, w - left_w, 0)
        starts = np.searchsorted(level, np.arange(level[-1] + 2))
        # Nodes that were open come first, then those closed as children, which have no row of their own.
        child = np.full((len(level), 2), -1)
        closed_w, closed_n, total = [], [], len(level)
        for d in range(level[-1] + 1):
            rows = slice(starts[d], starts[d + 1])
            left, right = open_children(feature[rows], n[rows], left_n[rows], least, d, max_depth)
            number = _numbered(left, right)
            child[rows] = np.where(number >= 0, number + starts[d + 1], -1)
        for side, (side_w, side_n) in enumerate(((left_w, left_n), (right_w, right_n))):
            shut = np.flatnonzero((feature >= 0) & (child[:, side] < 0))
            child[shut, side] = total + np.arange(len(shut))
            total += len(shut)
            closed_w.append(side_w[shut])
            closed_n.append(side_n[shut])
        stats, counts = np.concatenate([w, *closed_w]), np.concatenate([n, *closed_n]).sum(axis=1)
        says = stats.argmax(axis=1)
        leaf = np.ones(total, bool)
        leaf[: len(level)] = feature < 0
        for d in range(level[-1], -1, -1):
            rows = np.flatnonzero(~leaf[starts[d]: starts[d + 1]]) + starts[d]
            both = child[rows]
            same = leaf[both].all(axis=1) & (says[both[:, 0]] == says[both[:, 1]])
            leaf[rows[same]] = True
        # Numbers from 0 by level, so that children come after their parent.
        order, now = [], np.zeros(1, np.int64)
        while len(now):
            order.append(now)
            now = child[now[~leaf[now]]].ravel()
        order = np.concatenate(order)
        number = np.full(total, -1)
        number[order] = np.arange(len(order))
        inner = ~leaf[order]
        left, right, of, threshold, gained = (np.full(len(order), -1.0) for _ in range(5))
        own = order[inner]
        left[inner], right[inner] = number[child[own, 0]], number[child[own, 1]]
        of[inner], threshold[inner], gained[inner] = feature[own], cuts.value[feature[own], end[own]], gain[own]
        return pa.table({
            "treeID": pa.array(np.full(len(order), table["tree"][0].as_py()), pa.int32()), "id": pa.array(np.arange(len(order)), pa.int32()),
            "prediction": says[order].astype(np.float64), "impurity": _gini(stats[order]), "impurityStats": _lists(stats[order]),
            "rawCount": counts[order], "gain": gained, "leftChild": pa.array(left, pa.int32()), "rightChild": pa.array(right, pa.int32()),
            "featureIndex": pa.array(of, pa.int32()), "threshold": threshold,
        })

    return make


def fit(rows: DataFrame, params: RandomForestClassifier) -> RandomForestClassificationModel:
    """Train on ``features``, the label column and, if named, the weight column of ``params``, whose trees, depth, bins, least rows of a
    node and seed hold."""
    import numpy as np

    spark = rows.sparkSession
    label, weighted = params.getLabelCol(), params.isDefined("weightCol") and params.getWeightCol()
    rows = rows.select("features", F.col(label).alias("y"), F.col(params.getWeightCol()).cast("double").alias("w") if weighted else F.lit(1.0).alias("w"))
    first = rows.select("features").first()
    if first is None:
        raise ValueError("a forest needs training rows")
    n_features = first["features"].size
    classes = int(rows.agg(F.max("y")).first()[0]) + 1
    n_trees, bins, least = params.getNumTrees(), params.getMaxBins(), params.getMinInstancesPerNode()
    max_depth, seed = params.getMaxDepth(), params.getSeed()
    n_drawn = n_features if n_trees == 1 else int(np.ceil(np.sqrt(n_features)))
    ends = cut_points(rows, n_features, bins)
    zero_bin = (ends < 0).sum(axis=1)
    cuts = spark.sparkContext.broadcast(ends)
    numbered = rows.withColumn("_at", F.monotonically_increasing_id())
    state = measured(numbered.mapInArrow(_start(n_trees, cuts, seed), _STATE), "forest-rows")
    levels = []
    for level in range(max(1, max_depth)):
        sums = state.mapInArrow(_sums(n_trees, level, seed, n_features, n_drawn, bins, classes), _CELLS)
        sums = sums.groupBy("tree", "node", "cell").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
        sums = sums.repartition("tree", "node").sortWithinPartitions("tree", "node")
        found = measured(sums.mapInArrow(_best(zero_bin, bins, classes, least if max_depth else 2**62), _SPLITS), "forest-splits")
        levels.append(found.withColumn("level", F.lit(level)))
        told = found.select("tree", "node", "feature", "bin", "n", "left_n").toArrow().sort_by([("tree", "ascending"), ("node", "ascending")])
        tree, feature, end = (told[x].to_numpy() for x in ("tree", "feature", "bin"))
        n, left_n = (_matrix(told[x].combine_chunks(), classes) for x in ("n", "left_n"))
        left, right = open_children(feature, n, left_n, least, level, max_depth)
        if not (left | right).any():
            break
        at = np.searchsorted(tree, np.arange(n_trees + 1))
        of = [slice(at[i], at[i + 1]) for i in range(n_trees)]
        splits = spark.sparkContext.broadcast([(feature[x], end[x], _numbered(left[x], right[x])) for x in of])
        state = measured(state.mapInArrow(_moved(n_trees, n_features, splits, zero_bin), _STATE), "forest-rows")
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    flat = _NODE.replace("split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>", "featureIndex int, threshold double")
    nodes = nodes.groupBy("tree").applyInArrow(_tree_nodes(cuts, classes, least, max_depth), f"treeID int, {flat}")
    return _model(nodes, params, n_features, classes)


def _model(nodes: DataFrame, params: RandomForestClassifier, n_features: int, classes: int) -> RandomForestClassificationModel:
    """Spark ML's model of these nodes: a forest of roots alone is saved, given the nodes, and read back."""
    spark = nodes.sparkSession
    stump = spark.createDataFrame([(Vectors.sparse(n_features, {}), float(i)) for i in range(classes)], ["features", "y"])
    roots = RandomForestClassifier(featuresCol=params.getFeaturesCol(), labelCol="y", numTrees=params.getNumTrees(), maxDepth=0, seed=params.getSeed())
    path = scratch_path(spark, "forest-model")
    roots.fit(stump.withColumnRenamed("features", params.getFeaturesCol())).write().save(path)
    split = F.struct("featureIndex", F.when(F.col("featureIndex") >= 0, F.array("threshold")).otherwise(F.array().cast("array<double>"))
                     .alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories")).alias("split")
    kept = ("id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild")
    nodes.select("treeID", F.struct(*kept, split).alias("nodeData")).write.mode("overwrite").parquet(f"{path}/data")
    about = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    about["paramMap"] = {p.name: v for p, v in params.extractParamMap().items() if params.isSet(p) and p.name in about["defaultParamMap"]}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return RandomForestClassificationModel.load(path)
