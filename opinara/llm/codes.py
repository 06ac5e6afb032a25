"""Short codes of vectors: each part of a vector is replaced by the index of its nearest codebook entry.

The codebooks are found by rounds of nearest-entry assignment and averaging over all rows. Every block of rows gets one
metric tree per part, built middle-out by the anchors hierarchy: about ``sqrt(n)`` anchors take over the points nearest
to them, anchors are joined in pairs of least enclosing ball up to the root, and the points of an anchor are split the
same way downwards. A ball caches the sum and the number of its points. Trees are written once; each round walks them
from the root with the entries that can still be nearest. A ball passes on only the entries that survive its radius,
and once a single one is left the ball is wholly owned: its sum and number are added without looking at a point.

All arithmetic that decides is in integers: pruning leaves out only entries that are strictly farther for every point of
a ball, and what is left is compared exactly, the lower index winning ties. Equal parts of a block are one point with a
weight, so a vector that many rows share costs no more than its rows. What the driver sees of a round is the codebook:
one sum and number per part and entry.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite entry are left out, and so are those of
any but the most common length; a length that cannot be cut equally gives the first parts one entry more; with fewer
distinct ids than entries there are as many entries as ids; the entry of an id that occurs on several rows is the least
of its vectors; a null id seeds no entry unless no other id is there, and its rows get codes like any others; repeated
rows weigh as often as they occur; scaled entries beyond ``LIMIT`` are held at it; an empty table gives an empty result;
other columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import equal_rows, measured
from opinara.llm.vectors import floored, matrix, usable

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Squared distances of whole vectors of up to 1,024 entries stay below the largest long.
LIMIT = 2**25
#: Rows that share a tree, and points that a ball keeps undivided.
BLOCK, LEAF = 4096, 32
#: Largest integer up to which doubles are exact.
EXACT = 2**53


def cuts(width: int, parts: int) -> list[int]:
    """Where each part begins, and the end."""
    return [k * (width // parts) + min(k, width % parts) for k in range(parts + 1)]


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances between integer rows."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * max(1, points.shape[1]) < EXACT:
        # Products of doubles are faster, and exact up to here.
        points, entries = points.astype("float64"), entries.astype("float64")
    cross = points @ entries.T
    return ((points * points).sum(axis=1)[:, None] - 2 * cross + (entries * entries).sum(axis=1)[None, :]).astype("int64")


@dataclass
class Tree:
    """Balls over the points ``low:high`` of a block; children come after their parent, -1 is none."""

    points: np.ndarray  # in the order of the leaves
    weights: np.ndarray
    place: np.ndarray  # of each row, its point
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    sums: np.ndarray
    counts: np.ndarray


# Name, type and whether rows of a part's width, as the fields of a tree are stored.
FIELDS = (
    ("points", "int32", True), ("weights", "int64", False), ("place", "int32", False), ("low", "int32", False),
    ("high", "int32", False), ("left", "int32", False), ("right", "int32", False), ("centres", "float64", True),
    ("radii", "float64", False), ("sums", "int64", True), ("counts", "int64", False),
)


def packed(tree: Tree) -> dict[str, bytes]:
    return {name: np.ascontiguousarray(getattr(tree, name), dtype=kind).tobytes() for name, kind, _ in FIELDS}


def unpacked(stored: dict[str, bytes], width: int) -> Tree:
    return Tree(**{
        name: np.frombuffer(stored[name], dtype=kind).reshape(-1, width) if wide else np.frombuffer(stored[name], dtype=kind)
        for name, kind, wide in FIELDS
    })


class Builder:
    """Middle-out construction over distinct weighted points."""

    def __init__(self, points: np.ndarray, weights: np.ndarray, leaf: int = LEAF):
        self.points, self.weights, self.leaf = points.astype("float64"), weights, leaf

    def anchors(self, at: np.ndarray) -> list[np.ndarray]:
        """The points ``at``, dealt to about the square root of their number of anchors."""
        points = self.points[at]
        homes = [points[0]]
        owner, far = np.zeros(len(at), dtype=int), np.linalg.norm(points - points[0], axis=1)
        for _ in range(int(np.ceil(np.sqrt(len(at)))) - 1):
            new = far.argmax()  # the farthest point of the widest anchor
            if not far[new]:
                break
            apart = np.linalg.norm(np.array(homes) - points[new], axis=1)
            # Points nearer to their anchor than half the way to the new one cannot change over.
            asked = np.flatnonzero(far > apart[owner] / 2)
            step = np.linalg.norm(points[asked] - points[new], axis=1)
            won = step < far[asked]
            owner[asked[won]], far[asked[won]] = len(homes), step[won]
            homes.append(points[new])
        return [at[owner == k] for k in range(len(homes)) if (owner == k).any()]

    def ball(self, at: np.ndarray) -> dict:
        """Centre, radius and children of the points ``at``."""
        weights = self.weights[at]
        centre = (self.points[at] * weights[:, None]).sum(axis=0) / weights.sum()
        ball = {"at": at, "children": (), "centre": centre, "weight": weights.sum(), "radius": np.linalg.norm(self.points[at] - centre, axis=1).max()}
        if len(at) > self.leaf:
            parts = self.anchors(at)
            if len(parts) > 1:
                ball["children"] = self.joined([self.ball(p) for p in parts])["children"]
        return ball

    def joined(self, balls: list[dict]) -> dict:
        """Pairs of least enclosing radius, joined up to one ball."""
        n = len(balls)
        centres, radii = np.array([b["centre"] for b in balls]), np.array([b["radius"] for b in balls])
        weights = np.array([float(b["weight"]) for b in balls])

        def widths(k: int) -> np.ndarray:
            """Radius around the common centre of ball k with each other one."""
            apart, both = np.linalg.norm(centres - centres[k], axis=1), weights + weights[k]
            out = np.maximum(apart * weights / both + radii[k], apart * weights[k] / both + radii)
            out[k] = np.inf
            return out

        alive = np.ones(n, dtype=bool)
        table = np.stack([widths(k) for k in range(n)])
        for _ in range(n - 1):
            a, b = np.unravel_index(table.argmin(), table.shape)
            one, two = balls[a], balls[b]
            at = np.concatenate((one["at"], two["at"]))
            centre = (one["centre"] * weights[a] + two["centre"] * weights[b]) / (weights[a] + weights[b])
            radius = np.linalg.norm(self.points[at] - centre, axis=1).max()
            balls[a] = {"at": at, "children": (one, two), "centre": centre, "weight": one["weight"] + two["weight"], "radius": radius}
            alive[b] = False
            centres[a], radii[a], weights[a] = centre, radius, float(balls[a]["weight"])
            table[b, :] = table[:, b] = np.inf
            row = np.where(alive, widths(a), np.inf)
            table[a, :], table[:, a] = row, row
        return balls[int(np.flatnonzero(alive)[0])]


def grown(rows: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree of some integer rows."""
    points, place, weights = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    place = place.reshape(-1)
    root = Builder(points, weights, leaf).ball(np.arange(len(points)))
    order, balls, todo = [], [], [(root, -1, 0)]
    fields = {k: [] for k in ("low", "high", "left", "right")}
    at = 0
    while todo:
        ball, parent, side = todo.pop()
        k = len(balls)
        balls.append(ball)
        if parent >= 0:
            fields[("left", "right")[side]][parent] = k
        fields["low"].append(at)
        fields["high"].append(at + len(ball["at"]))
        fields["left"].append(-1)
        fields["right"].append(-1)
        if ball["children"]:
            # The left child is taken next, so the points of a ball lie together.
            todo += [(ball["children"][1], k, 1), (ball["children"][0], k, 0)]
        else:
            order.append(ball["at"])
            at += len(ball["at"])
    order = np.concatenate(order)
    back = np.empty(len(order), dtype=int)
    back[order] = np.arange(len(order))
    points, weights = points[order], weights[order]
    low, high = np.array(fields["low"]), np.array(fields["high"])
    before = np.concatenate((np.zeros((1, points.shape[1]), dtype="int64"), np.cumsum(points * weights[:, None], axis=0)))
    counted = np.concatenate(([0], np.cumsum(weights)))
    return Tree(
        points, weights, back[place], low, high, np.array(fields["left"]), np.array(fields["right"]),
        np.array([b["centre"] for b in balls]), np.array([b["radius"] for b in balls]), before[high] - before[low], counted[high] - counted[low],
    )


def walk(tree: Tree, entries: np.ndarray, owned, asked) -> None:
    """Call ``owned(ball, entry)`` for balls with one entry left, ``asked(ball, entries, distances)`` for other leaves."""
    places = entries.astype("float64")
    todo = [(0, np.arange(len(entries)))]
    while todo:
        ball, left = todo.pop()
        far = np.linalg.norm(places[left] - tree.centres[ball], axis=1)
        # An entry stays unless it is farther than the nearest one for every point; the slack covers rounding only.
        bound = far.min() + 2 * tree.radii[ball]
        left = left[far <= bound + 1e-9 * (1 + bound)]
        if len(left) == 1:
            owned(ball, left[0])
        elif tree.left[ball] >= 0:
            todo += [(tree.left[ball], left), (tree.right[ball], left)]
        else:
            asked(ball, left, squared(tree.points[tree.low[ball]:tree.high[ball]].astype("int64"), entries[left]))


def gathered(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the points nearest to each entry."""
    sums, counts = np.zeros(entries.shape, dtype="int64"), np.zeros(len(entries), dtype="int64")

    def owned(ball, entry):
        sums[entry] += tree.sums[ball]
        counts[entry] += tree.counts[ball]

    def asked(ball, left, distances):
        at = slice(tree.low[ball], tree.high[ball])
        nearest = left[distances.argmin(axis=1)]
        np.add.at(sums, nearest, tree.points[at].astype("int64") * tree.weights[at, None])
        np.add.at(counts, nearest, tree.weights[at])

    walk(tree, entries, owned, asked)
    return sums, counts


def nearest(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each row of the block."""
    code, error = np.zeros(len(tree.points), dtype="int64"), np.zeros(len(tree.points), dtype="int64")

    def owned(ball, entry):
        at = slice(tree.low[ball], tree.high[ball])
        code[at] = entry
        error[at] = squared(tree.points[at].astype("int64"), entries[entry:entry + 1])[:, 0]

    def asked(ball, left, distances):
        at = slice(tree.low[ball], tree.high[ball])
        best = distances.argmin(axis=1)
        code[at], error[at] = left[best], distances[np.arange(len(best)), best]

    walk(tree, entries, owned, asked)
    return code[tree.place], error[tree.place]


def first_entries(rows: DataFrame, vec_id: str, vector: str, entries: int, bounds: list[int], scale: int) -> list[np.ndarray]:
    """The codebooks to start with: parts of the vectors of the least ids."""
    ids = rows.select(vec_id).distinct().orderBy(F.col(vec_id).asc_nulls_last()).limit(entries)
    known = ids.where(F.col(vec_id).isNotNull())
    ids = measured(known if known.take(1) else ids, "ids")
    chosen = equal_rows(rows.select(vec_id, vector), ids, [vec_id], "left_semi").groupBy(vec_id).agg(F.min(vector).alias("v"))
    values = [r["v"] for r in chosen.orderBy(F.col(vec_id).asc_nulls_last()).collect()]
    x = floored(np.array(values, dtype="float64"), scale, LIMIT)
    return [x[:, a:b] for a, b in zip(bounds, bounds[1:])]


def forest(rows: DataFrame, vec_id: str, vector: str, label: str, width: int, bounds: list[int], scale: int, block: int) -> DataFrame:
    """One row per block: ids, labels and the tree of each part."""
    types = {c: rows.schema[c].dataType.simpleString() for c in (vec_id, label)}
    kind = "struct<" + ",".join(f"{name}:binary" for name, _, _ in FIELDS) + ">"

    def task(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, block):
                part = batch.slice(low, block)
                x = floored(matrix(part.column(2), width), scale, LIMIT)
                trees = [packed(grown(x[:, a:b])) for a, b in zip(bounds, bounds[1:])]
                yield pa.record_batch([
                    *[pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(i)) for i in (0, 1)],
                    pa.array([trees], pa.list_(pa.struct([(name, pa.binary()) for name, _, _ in FIELDS]))),
                ], names=["ids", "labels", "trees"])

    out = rows.select(vec_id, label, vector).mapInArrow(
        task, f"ids array<{types[vec_id]}>, labels array<{types[label]}>, trees array<{kind}>")
    return measured(out, "trees")


def updated(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every entry becomes the floored mean of the parts nearest to it, unused ones stay."""
    wide = max(b.shape[1] for b in books)

    def task(batches):
        sums, counts = [np.zeros(b.shape, dtype="int64") for b in books], [np.zeros(len(b), dtype="int64") for b in books]
        for batch in batches:
            for i in range(batch.num_rows):
                for k, stored in enumerate(batch.column(0)[i].as_py()):
                    s, c = gathered(unpacked(stored, books[k].shape[1]), books[k])
                    sums[k] += s
                    counts[k] += c
        used = [(k, int(e)) for k, c in enumerate(counts) for e in np.flatnonzero(c)]
        yield pa.record_batch([
            pa.array([u[0] for u in used], pa.int32()), pa.array([u[1] for u in used], pa.int32()),
            pa.array([int(counts[k][e]) for k, e in used], pa.int64()), pa.array([sums[k][e].tolist() for k, e in used], pa.list_(pa.int64())),
        ], names=["part", "entry", "n", "sums"])

    parts = trees.select("trees").mapInArrow(task, "part int, entry int, n bigint, sums array<bigint>")
    total = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38, 0)")).alias(f"s{i}") for i in range(wide)]
    out = [b.copy() for b in books]
    for r in parts.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():
        book = out[r["part"]]
        book[r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(book.shape[1])]
    return out


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components as decimal text, comma-joined, by part, entry and position."""
    return sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def train(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK,
) -> tuple[DataFrame, list[np.ndarray]]:
    """The written trees of all usable rows and the codebooks after the last round; no codebooks without rows."""
    rows, width = usable(df, vector)
    bounds = cuts(width, parts)
    trees = forest(rows, vec_id, vector, label, width, bounds, scale, block)
    books = first_entries(rows, vec_id, vector, entries, bounds, scale) if width else []
    for _ in range(rounds if books else 0):
        books = updated(trees, books)
    return trees, books


def encode(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK,
) -> DataFrame:
    """vec_id, label, code (two hex digits per part), error, label_error and codebooks_sha256 of every usable row."""
    trees, books = train(df, vec_id, vector, label, parts, entries, rounds, scale, block)
    digits = max(2, len(f"{max(0, entries - 1):x}"))

    def task(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch.column(0)[i].values, batch.column(1)[i].values
                found = [nearest(unpacked(t, books[k].shape[1]), books[k]) for k, t in enumerate(batch.column(2)[i].as_py())]
                code = ["".join(f"{c:0{digits}x}" for c in row) for row in zip(*(f[0].tolist() for f in found))]
                error = sum(f[1] for f in found)
                yield pa.record_batch([ids, labels, pa.array(code), pa.array(error, pa.int64())],
                                      names=["vec_id", "label", "code", "error"])

    types = [df.schema[c].dataType.simpleString() for c in (vec_id, label)]
    schema = f"vec_id {types[0]}, label {types[1]}, code string, error bigint"
    coded = measured(trees.mapInArrow(task, schema), "codes")
    sums = measured(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    joined = equal_rows(coded, sums, ["label"], "left")
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
