"""Writers: tables, predictions, parameters, models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.sources.readers import NULL_MARK, slashed


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Files that ``readers.read_csv`` gives back as they were: NULL, empty texts, line breaks and white space."""
    options = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8", "nullValue": NULL_MARK, "emptyValue": '""',
               "quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    marked = {f.name: slashed(f.name, r"^(\\+N)$", r"\\$1") for f in df.schema.fields if f.dataType == T.StringType()}
    df.withColumns(marked).write.mode(mode).options(**options).csv(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("source", "year"), mode: str = "error") -> None:
    """Parquet, partitioned for pruning.

    Rows are rebalanced on the partition columns first: adaptive execution splits a hot partition into
    several files and merges tiny ones.
    """
    keys = [c for c in partition_by if c in df.columns]
    out = df.hint("rebalance", *[F.col(k) for k in keys]) if keys else df
    writer = out.write.mode(mode)
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def prediction_table(predictions: DataFrame, row_id: str, labels: list[str]) -> DataFrame:
    """Actual, predicted and class probabilities of a row side by side, matched by the row itself."""
    probabilities = [c for c in (f"prob_{x}" for x in labels) if c in predictions.columns]
    return predictions.select(row_id, "actual", "predicted", *probabilities)


def export_predictions(predictions: DataFrame, row_id: str, labels: list[str], path: str, mode: str = "error") -> None:
    write_csv(prediction_table(predictions, row_id, labels), path, mode)


def parameter_table(spark: SparkSession, params: dict) -> DataFrame:
    """Run parameters as ``(parameter, value)``, values as JSON text."""
    import json

    return spark.createDataFrame([(k, json.dumps(v)) for k, v in params.items()], "parameter string, value string")


def parameters_json(params: DataFrame) -> DataFrame:
    """All parameters of a run, or of each run when there is a ``run`` column, as one JSON object."""
    keys = [c for c in params.columns if c not in ("parameter", "value")]
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("parameter", "value"))))
    return params.groupBy(*keys).agg(F.to_json(entries).alias("json"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
