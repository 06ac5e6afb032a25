"""Whitening of vectors by a covariance that is put together from variances alone.

Entries become integers, so every sum is exact. One pass gives the number of vectors and the sum of each dimension.
A second one adds up the squares of the centred values of every dimension and of the sum of every two dimensions;
by polarisation, ``cov(a, b) = (var(a + b) - var(a) - var(b)) / 2``. The driver sees one exact number per dimension or
pair, never a vector, and decomposes the matrix with ``eigh``.

Centring is exact too: with ``m = floor(S / n)`` and ``r = S - n * m`` the tasks square ``u = x - m``, and
``sum((n * x - S) ** 2) = n * (n * sum(u ** 2) - r ** 2)`` takes away what is left of the mean, in integers of any size.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite entry are left out, and so are those of
any but the most common length; a null id is kept as it is; repeated rows count as often as they occur; an entry beyond
``LIMIT`` after scaling is held at it; a component without variance (below rounding of the largest) cannot be scaled to
one, so its ``whitened`` is null and the identity is judged without it; ``deviation`` is null where it exceeds a
long; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.vectors import floored, matrix, usable

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
LIMIT = 2**40
#: Rows whose pair sums are squared at a time.
STRETCH = 4096
LONG = 2**63 - 1


@dataclass(frozen=True)
class Whitening:
    """What a fit has found; ``n``, ``sums`` and the sums behind ``covariance`` are exact."""

    n: int
    sums: tuple[int, ...]
    covariance: np.ndarray
    vectors: np.ndarray  # one column per component
    values: np.ndarray  # falling
    explained: np.ndarray | None

    @property
    def middle(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole part and remainder (times n) of the mean of each dimension."""
        return tuple(np.array([f(s, self.n) for s in self.sums], dtype="int64") for f in (int.__floordiv__, int.__mod__))

    @property
    def scaled(self) -> np.ndarray:
        """Which components have variance."""
        return self.values > max(self.values[0], 0.0) * len(self.sums) * np.finfo(float).eps


def integers(column: pa.Array, width: int, scale: int, shift: int) -> np.ndarray:
    return floored(matrix(column, width), scale, LIMIT) + shift


def totals(rows: DataFrame, vector: str, width: int, scale: int, shift: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of every dimension."""

    def task(batches):
        n, sums = 0, np.zeros(width, dtype=object)
        for batch in batches:
            x = integers(batch.column(0), width, scale, shift)
            for low in range(0, len(x), 1024):  # short stretches stay below the largest long
                sums = sums + x[low:low + 1024].sum(axis=0).astype(object)
            n += len(x)
        if n:
            yield decimals([("i", range(width), pa.int32()), ("s", sums, None), ("n", [n] * width, pa.int64())])

    parts = rows.select(vector).mapInArrow(task, "i int, s decimal(38, 0), n bigint")
    found = parts.groupBy("i").agg(F.sum("s").cast("decimal(38, 0)").alias("s"), F.sum("n").alias("n")).collect()
    by = {r["i"]: r for r in found}
    return (by[0]["n"], [int(by[i]["s"]) for i in range(width)]) if by else (0, [])


def decimals(columns) -> pa.RecordBatch:
    """A batch of columns (name, values, type); those without a type are exact integers of any size."""
    arrays = [
        pa.array(v, t) if t else pa.array([Decimal(int(x)) for x in v], pa.decimal128(38, 0)) for _, v, t in columns
    ]
    return pa.record_batch(arrays, names=[c[0] for c in columns])


def squares(centred: np.ndarray) -> list[np.ndarray]:
    """For each dimension a: sums of ``(u_a + u_b) ** 2`` for b from a on, the first of them ``u_a ** 2`` itself."""
    most = int(np.abs(centred).max(initial=0))
    if 4 * most * most * len(centred) > LONG:
        centred = centred.astype(object)
    out = []
    for a in range(centred.shape[1]):
        both = centred[:, a:] + centred[:, a:a + 1]
        both[:, 0] = centred[:, a]
        out.append((both * both).sum(axis=0))
    return out


def covariance(rows: DataFrame, vector: str, n: int, sums: list[int], scale: int, shift: int) -> np.ndarray:
    """Covariances of all pairs of dimensions, from exact sums of squares, each rounded once."""
    width = len(sums)
    whole, left = [s // n for s in sums], [s % n for s in sums]
    middle = np.array(whole, dtype="int64")
    first, second = np.triu_indices(width)

    def task(batches):
        sums_of = None
        for batch in batches:
            u = integers(batch.column(0), width, scale, shift) - middle
            for low in range(0, len(u), STRETCH):
                part = np.concatenate(squares(u[low:low + STRETCH])).astype(object)
                sums_of = part if sums_of is None else sums_of + part
        if sums_of is not None:
            yield decimals([("a", first, pa.int32()), ("b", second, pa.int32()), ("s", sums_of, None)])

    parts = rows.select(vector).mapInArrow(task, "a int, b int, s decimal(38, 0)")
    found = {(r["a"], r["b"]): int(r["s"]) for r in parts.groupBy("a", "b").agg(F.sum("s").cast("decimal(38, 0)").alias("s")).collect()}
    # n times the variance of n * x, of a dimension and of the sum of two.
    own = [n * found[a, a] - left[a] ** 2 for a in range(width)]
    out = np.zeros((width, width))
    for a in range(width):
        out[a, a] = own[a] / n**2
        for b in range(a + 1, width):
            pair = n * found[a, b] - (left[a] + left[b]) ** 2
            out[a, b] = out[b, a] = (pair - own[a] - own[b]) / (2 * n**2)
    return out


def fit(df: DataFrame, vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """Means and components of all usable vectors; None without any."""
    rows, width = usable(df, vector)
    n, sums = totals(rows, vector, width, scale, shift) if width else (0, [])
    if not n:
        return None
    cov = covariance(rows, vector, n, sums, scale, shift)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1].copy(), vectors[:, ::-1].copy()
    # The largest entry of a component is positive, so that equal input gives equal signs.
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(width)] < 0, -1.0, 1.0)
    trace = float(np.trace(cov))
    return Whitening(n, tuple(sums), cov, vectors, values, values / trace if trace > 0 else None)


def projected(u: np.ndarray, model: Whitening, components: int) -> np.ndarray:
    """Centred values on the first components, over their standard deviations; NaN where there is no variance."""
    exact = u - model.middle[1] / model.n
    with np.errstate(divide="ignore", invalid="ignore"):
        over = np.where(model.scaled, 1 / np.sqrt(np.maximum(model.values, 0)), np.nan)[:components]
        return (exact @ model.vectors[:, :components]) * over


def deviations(u: np.ndarray, model: Whitening) -> pa.Array:
    """Exact sum over dimensions of ``(n * x - S) ** 2``, null beyond a long."""
    left = model.middle[1]
    most = int(np.abs(u).max(initial=0)) + 1
    if (model.n * most) ** 2 * u.shape[1] > LONG:
        u, left = u.astype(object), left.astype(object)
    y = model.n * u - left
    return pa.array([v if v <= LONG else None for v in (y * y).sum(axis=1).tolist()], pa.int64())


def identity_error(rows: DataFrame, vector: str, model: Whitening, components: int, scale: int, shift: int) -> float | None:
    """Largest entry, by size, of the covariance of the whitened values less the identity.

    Tasks give their number of rows, means and centred products; the means between tasks are added in one aggregate.
    """
    width = len(model.sums)
    real = np.flatnonzero(model.scaled[:components])
    if not len(real):
        return None
    first, second = np.triu_indices(len(real))
    schema = "a int, b int, n bigint, pa double, pb double, p double"

    def task(batches):
        n, mean, products = 0, np.zeros(len(real)), np.zeros((len(real), len(real)))
        for batch in batches:
            z = projected(integers(batch.column(0), width, scale, shift) - model.middle[0], model, components)[:, real]
            own = z.mean(axis=0)
            step = own - mean
            products += (z - own).T @ (z - own) + np.outer(step, step) * (n * len(z) / (n + len(z)))
            mean = mean + step * (len(z) / (n + len(z)))
            n += len(z)
        if n:
            sizes = np.full(len(first), n)
            yield pa.record_batch([
                pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(sizes, pa.int64()),
                pa.array(mean[first]), pa.array(mean[second]), pa.array(products[first, second]),
            ], names=["a", "b", "n", "pa", "pb", "p"])

    n = F.sum("n")
    between = F.sum(F.col("n") * F.col("pa") * F.col("pb")) - F.sum(F.col("n") * F.col("pa")) * F.sum(F.col("n") * F.col("pb")) / n
    cov = (F.sum("p") + between) / n
    wanted = (F.col("a") == F.col("b")).cast("double")
    found = rows.select(vector).where(F.size(vector) == width).mapInArrow(task, schema).groupBy("a", "b").agg(cov.alias("c"))
    return found.agg(F.max(F.abs(F.col("c") - wanted))).first()[0]


def whiten(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
    scale: int = SCALE, shift: int = SHIFT, model: Whitening | None = None,
) -> DataFrame:
    """One row per usable vector and component, of the model given or else fitted on the same rows."""
    kind = df.schema[vec_id].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double")
    model = model or fit(df, vector, scale, shift)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    width = len(model.sums)
    upto = min(components, width)
    rows = usable(df, vector)[0].where(F.size(vector) == width)
    error = identity_error(rows, vector, model, upto, scale, shift)
    explained = model.explained

    def task(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, STRETCH):
                part = batch.slice(low, STRETCH)
                u = integers(part.column(1), width, scale, shift) - model.middle[0]
                z, places = projected(u, model, upto), np.repeat(np.arange(len(u)), upto)
                share = pa.nulls(len(places), pa.float64()) if explained is None else pa.array(np.tile(explained[:upto], len(u)))
                yield pa.record_batch([
                    part.column(0).take(pa.array(places)), pa.array(np.tile(np.arange(1, upto + 1), len(u)), pa.int32()),
                    pa.array(np.full(len(places), model.n), pa.int64()), deviations(u, model).take(pa.array(places)),
                    pa.array(z.ravel(), from_pandas=True), share,
                    pa.array([error] * len(places), pa.float64()),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(vec_id, vector).mapInArrow(task, schema)
