"""Readers. Every one has an explicit schema; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara import schemas, vocab
from opinara.functions import calendar, keywords, text
from opinara.operators import relevance, shaping
from opinara.sources import records

#: What stands for NULL in a file, so that an empty text stays one. A text that looks like it carries one more backslash.
NULL_MARK = "\\N"
RAW_SCHEMAS = {vocab.PLATFORM_A: schemas.RAW_A, vocab.PLATFORM_B: schemas.RAW_B}


def slashed(column: str, pattern: str, to: str) -> Column:
    """Replace a pattern that only fits texts which begin with a backslash; others are not searched."""
    return F.when(F.startswith(F.col(column), F.lit("\\")), F.regexp_replace(column, pattern, to)).otherwise(F.col(column))


class MissingData(FileNotFoundError):
    """The path to load does not exist."""


def _checked(reader, path: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return reader(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise MissingData(f"data not found: {path}") from error
        raise


def read_csv(spark: SparkSession, path: str, schema: str, mark: str = NULL_MARK, header: bool = True, with_order: bool = False) -> DataFrame:
    """Rows of delimited files; quoted fields may hold line breaks, and one file is still read by many tasks.

    An empty field is NULL, an empty field in quotes an empty text. With ``mark=""`` both are NULL, and no text is taken
    for a marked one. ``with_order`` adds source_file, block_start and row_order, which order rows as they stand in files.
    """
    options = {"quote": '"', "escape": '"', "multiLine": "true", "nullValue": mark, "emptyValue": ""}
    rows = records.parsed(_checked(lambda p: records.records(spark, p), path), schema, options, header)
    if mark:
        rows = rows.withColumns({
            f.name: slashed(f.name, r"^\\(\\+N)$", "$1") for f in T._parse_datatype_string(schema).fields if f.dataType == T.StringType()
        })
    return rows if with_order else rows.drop("source_file", "block_start", "row_order")


def read_platform(spark: SparkSession, path: str, platform: str, fmt: str = "csv") -> DataFrame:
    """Raw table of one platform."""
    schema = RAW_SCHEMAS[platform]
    return read_csv(spark, path, schema) if fmt == "csv" else _checked(spark.read.schema(schema).format(fmt).load, path)


def read_final(spark: SparkSession, path: str, fmt: str = "csv", schema: str = schemas.FINAL) -> DataFrame:
    """The processed table with its timestamp and category types."""
    df = read_csv(spark, path, schema) if fmt == "csv" else _checked(spark.read.format(fmt).load, path)
    return shaping.finalise_types(df)


def read_records(spark: SparkSession, paths: str | list[str], schema: str = schemas.RECORDS) -> DataFrame:
    """Collected records, one JSON object per line, from one or many batches."""
    return _checked(spark.read.schema(schema).json, paths)


def with_file_order(df: DataFrame, path: str = "source_file", start: str = "block_start", row: str = "row_order") -> DataFrame:
    """Add columns that order rows as they stand in their files; call it directly on a file scan."""
    return df.select(
        "*", F.col("_metadata.file_path").alias(path), F.col("_metadata.file_block_start").alias(start),
        F.monotonically_increasing_id().alias(row),
    )


def with_dashboard_features(df: DataFrame, column: str = "cleaned_text") -> DataFrame:
    c = F.col(column)
    return df.withColumns({
        "text_length": text.char_length(c),
        "word_count": text.word_count(c),
        "avg_word_length": text.average_word_length(c),
        "ai_keyword_count": keywords.distinct_hits(c),
        "exclamation_count": text.count_char(c, "!"),
        "question_count": text.count_char(c, "?"),
        "has_question": text.has_char(c, "?"),
        "has_exclamation": text.has_char(c, "!"),
    })


def dashboard_view(df: DataFrame) -> DataFrame:
    """Aliases, calendar columns, critical nulls dropped, text features added."""
    df = shaping.alias_if_missing(df)
    if "cleaned_text" not in df.columns and "text" in df.columns:
        df = df.withColumn("cleaned_text", F.col("text"))
    if "timestamp" in df.columns:
        if dict(df.dtypes)["timestamp"] == "string":
            df = df.withColumn("timestamp", calendar.parse_iso("timestamp"))
        ts = F.col("timestamp")
        df = df.withColumns({"date": F.to_date(ts), "year": F.year(ts), "month": F.month(ts), "month_name": calendar.month_name(ts)})
    df = relevance.drop_null_critical(df)
    return with_dashboard_features(df) if "cleaned_text" in df.columns else df


def load_dashboard(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return dashboard_view(read_final(spark, path, fmt))
