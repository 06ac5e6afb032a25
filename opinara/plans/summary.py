"""Run summaries as ``(metric, value)`` rows from one combined aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.operators.shaping import rows_from


def run_summary(df: DataFrame, means: list[str], uniques: list[str] = (), flags: list[str] = ()) -> DataFrame:
    """Rows, distinct values, means and flag totals of a run."""
    aggregates = {"rows": F.count("*")}
    aggregates.update({f"unique_{c}": F.count_distinct(F.col(c)) for c in uniques})
    aggregates.update({f"mean_{c}": F.avg(c) for c in means})
    aggregates.update({f"total_{c}": F.sum(F.col(c).cast("int")) for c in flags})
    return rows_from(df.agg(*[a.alias(n) for n, a in aggregates.items()]), [
        {"metric": F.lit(n), "value": F.col(n).cast("double")} for n in aggregates
    ])
