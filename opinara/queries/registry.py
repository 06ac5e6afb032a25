"""Registry of named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(spark, sf_dir)`` under a name, with its SQL when it has one."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, so that the order of additions does not show."""
    return df.select(*[
        F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def dates_as_text(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.date_format(f.name, "yyyy-MM-dd HH:mm:ss").alias(f.name) if isinstance(f.dataType, T.TimestampType)
        else F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.DateType)
        else F.col(f.name)
        for f in df.schema.fields
    ])
