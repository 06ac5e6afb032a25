"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.functions.text import once
from opinara.operators.sizing import measured

# Bytes that separate words: space and the five ASCII controls from tab to carriage return.
GAPS = r"[\x20\x09-\x0D]+"
#: Rows that a side table may have, by its count, to be sent to every executor.
BROADCAST_ROWS = 500_000

__all__ = ["BROADCAST_ROWS", "GAPS", "equal_rows", "measured", "once", "running", "text_key", "widened", "words"]


def words(text: Column) -> Column:
    """Words between gaps, case as it is; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAPS), lambda w: w != "")


def text_key(text: Column) -> Column:
    """Tells texts of the same id apart; rows equal in id and text are one document that occurs twice."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def equal_rows(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys that may be null, the keys taken from the left side."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    joined = left.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def running(lengths: Column, block: int = 64) -> Column:
    """Sum of the elements before each element, over blocks, so that long arrays do not cost their square."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int")),
        lambda b: total(F.slice(lengths, b * block + 1, F.lit(block))),
    )

    def before(sums: Column) -> Column:
        def at(_, i):
            whole = F.floor(i / block).cast("int")
            return total(F.slice(sums, F.lit(1), whole)) + total(F.slice(lengths, whole * block + 1, i - whole * block))

        return F.transform(lengths, at)

    return F.when(F.size(lengths) > 0, once(blocks, before)).otherwise(F.array().cast("array<bigint>"))


def widened(df: DataFrame, kept: list[str], added: str) -> T.StructType:
    """The schema of some columns of ``df`` followed by those of a DDL string."""
    return T.StructType([*[df.schema[c] for c in kept], *T._parse_datatype_string(added).fields])
