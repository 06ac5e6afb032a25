"""Helpers for the operators on vectors: which rows count, and rows of an Arrow column as a matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True where a vector is there, has entries, and every entry is a finite number."""
    good = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.coalesce(good & (F.size(vector) > 0), F.lit(False))


def usable(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows whose vector is finite and has the most common length, and that length (0 without such rows).

    Of equally common lengths the larger one counts. Entries that are neither float nor double are read as double.
    """
    entry = df.schema[vector].dataType.elementType.simpleString()
    if entry not in ("float", "double"):
        df = df.withColumn(vector, F.col(vector).cast("array<double>"))
    real = df.where(finite(F.col(vector)))
    lengths = real.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return real, 0
    return real.where(F.size(vector) == lengths["n"]), lengths["n"]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a column as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, width)


def floored(values: np.ndarray, scale: int, limit: int) -> np.ndarray:
    """``floor(scale * value)`` as long, held within ``limit`` either way."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * scale), -limit, limit).astype("int64")
