"""Delimited files whose quoted fields hold line breaks, cut into records by many tasks.

A reader that looks for the end of a quoted field has to start at the front of its file, which makes one file one task.
Here files are scanned as lines, which split anywhere. Whether a line starts inside quotes follows from the number of
quotes before it in its file, odd or even, doubled ones included:

1. One aggregate counts the quotes of every split. The running count over the splits of a file gives the splits that
   begin inside quotes, the only thing tasks have to know of each other: 16 bytes for each such split.
2. Every task joins its lines to records. A record that runs over the end of a split leaves a piece in each.
3. The pieces, two per split at most, are put together.

Rows never move, save those pieces, and fields are parsed where the records are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinara.operators.sizing import measured

#: What a piece is: a record of its own, the end of one begun in an earlier split (or all of a split inside it), its begin.
WHOLE, END, BEGIN = 0, 1, 2
SCHEMA = pa.schema([("source_file", pa.string()), ("block_start", pa.int64()), ("row_order", pa.int64()), ("piece", pa.int32()), ("record", pa.string())])
PLACE = ["source_file", "block_start"]


def lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(source_file, block_start, value) of every line, in file order inside a task."""
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block_start"), "value")


def starts_inside(read: DataFrame, quote: str) -> set[tuple[str, int]]:
    """The splits that begin inside quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    splits = read.groupBy(*PLACE).agg((F.sum(quotes) % 2).alias("odd"))
    before = W.partitionBy("source_file").orderBy("block_start").rowsBetween(W.unboundedPreceding, -1)
    inside = splits.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    return {(r["source_file"], r["block_start"]) for r in inside.where("inside").select(*PLACE).collect()}


class Joiner:
    """Joins the lines of one split, given in order and in batches, to records."""

    def __init__(self, place: tuple[str, int], inside: bool, quote: str):
        self.place, self.inside, self.quote = place, inside, quote
        self.open: list[str] = []
        self.first = not inside  # the open piece begins in this split
        self.began = self.seen = 0

    def rows(self, orders, pieces, records) -> pa.RecordBatch:
        n = len(orders)
        columns = [[self.place[0]] * n, [self.place[1]] * n, orders, pieces, records]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, SCHEMA.types)], schema=SCHEMA)

    def take(self, values: pa.Array) -> Iterator[pa.RecordBatch]:
        quotes = pc.count_substring(values, self.quote).to_numpy(zero_copy_only=False)
        inside = (np.cumsum(quotes) + self.inside) % 2 == 1  # after each line
        begin = self.seen
        self.seen += len(values)
        if not inside.any() and not self.inside:
            yield self.rows(np.arange(begin, self.seen), np.full(len(values), WHOLE), values)
            return
        text, low = values.to_pylist(), 0
        orders, pieces, records = [], [], []
        for end in np.flatnonzero(~inside):
            if not self.open:
                self.began = begin + low
            self.open += text[low:end + 1]
            orders.append(self.began)
            pieces.append(WHOLE if self.first else END)
            records.append("\n".join(self.open))
            self.open, self.first, low = [], True, int(end) + 1
        if low < len(text):
            if not self.open:
                self.began = begin + low
            self.open += text[low:]
        self.inside = bool(inside[-1]) if len(inside) else self.inside
        yield self.rows(orders, pieces, records)

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.open:
            yield self.rows([self.began], [BEGIN if self.first else END], ["\n".join(self.open)])


def records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """(source_file, block_start, row_order, record) of every record; the last two tell where in its file it begins."""
    read = lines(spark, path)
    inside = starts_inside(read, quote)

    def joined_lines(batches):
        joiner = None
        for batch in batches:
            files, blocks = batch.column(0), batch.column(1).to_numpy()
            # A task may read several splits; each is a run of rows of equal place.
            codes = pc.dictionary_encode(files).indices.to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                place = (files[low].as_py(), int(blocks[low]))
                if joiner is None or joiner.place != place:
                    if joiner:
                        yield from joiner.finish()
                    joiner = Joiner(place, place in inside, quote)
                yield from joiner.take(batch.column(2).slice(low, high - low))
        if joiner:
            yield from joiner.finish()

    def part(keep):
        """Records or pieces alone, so that no task hands on rows that are dropped next."""
        def task(batches):
            for batch in joined_lines(batches):
                yield batch if keep is None else batch.filter(keep(batch.column(3), WHOLE))

        return read.mapInArrow(task, "source_file string, block_start bigint, row_order bigint, piece int, record string")

    if not inside:
        # No record runs over the end of a split; a quote left open at the end of a file is a record, too.
        return part(None).drop("piece")
    pieces = measured(part(pc.not_equal), "pieces")
    in_file = W.partitionBy("source_file").orderBy("block_start", "piece").rowsBetween(W.unboundedPreceding, 0)
    numbered = pieces.select(*PLACE, "piece", F.sum((F.col("piece") == BEGIN).cast("int")).over(in_file).alias("_n"))
    joined = pieces.join(numbered, [*PLACE, "piece"]).groupBy("source_file", "_n").agg(
        F.min(F.struct("block_start", "piece", "row_order")).alias("_at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_start", "piece", "record"))), lambda x: x["record"]), "\n").alias("record"))
    joined = joined.select("source_file", F.col("_at.block_start").alias("block_start"), F.col("_at.row_order").alias("row_order"), "record")
    return part(pc.equal).drop("piece").unionByName(joined)


def parsed(found: DataFrame, schema: str, options: dict[str, str], header: bool = True) -> DataFrame:
    """Fields of the records by place, with the columns that order them; the first record of a file may be its header."""
    rows = found.where(~((F.col("block_start") == 0) & (F.col("row_order") == 0))) if header else found
    rows = rows.withColumn("record", F.regexp_replace("record", r"\r\z", "")).where(F.col("record") != "")
    return rows.select(F.from_csv("record", schema, options).alias("_r"), "source_file", "block_start", "row_order").select(
        "_r.*", "source_file", "block_start", "row_order")
