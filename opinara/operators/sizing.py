"""Decisions that depend on measured sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from opinara.session import scratch_path


def measured(df: DataFrame, name: str = "side") -> DataFrame:
    """Compute a narrow table once and read it back from the shared folder.

    The planner then knows its size in bytes: it broadcasts the table below
    ``spark.sql.autoBroadcastJoinThreshold`` and joins by sort-merge above it, where adaptive execution splits
    hot keys. Being written, the table is neither computed twice nor lost with an executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
