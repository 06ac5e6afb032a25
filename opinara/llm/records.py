"""Token ids in framed binary files, with a separate index of offsets.

One record per document: an unsigned 64-bit length, the masked CRC-32 of those eight bytes, the payload, the masked
CRC-32 of the payload, all little-endian. The payload is one byte for the width of an id (2 or 4 bytes, from the size
of the vocabulary), one byte that is 1 when the document has no id, the signed 64-bit document id, and the ids. The
mask turns the checksum by 15 bits and adds a constant, so that records nested in records do not carry their own
checksum unchanged. The index is a table of (part, doc_id, file, offset, n_bytes, n_ids, ids_before); it lets any
selection of records be read in any order.

Documents are dealt by ranges of id, so files follow each other in ascending id. A task writes a file of a name of
its own and only reports it in the index: a file left by a lost or repeated task is never read.

Defined cases: a null text is an empty one and holds the end id only; a null id comes first; rows of one id follow
each other by a hash of the text; other columns are not stored; an empty table has no files and an empty index.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinara.llm.common import measured, text_key
from opinara.llm.tokens import encoder
from opinara.session import scratch_path

MASK_ADD = 0xA282EAD8
HEAD, PREFIX = "<QI", "<BBq"
HEAD_BYTES, PREFIX_BYTES = struct.calcsize(HEAD), struct.calcsize(PREFIX)
WIDTHS = {2: "<u2", 4: "<u4"}
#: Neighbouring records are read together up to about so many bytes.
READ_BYTES = 4_000_000
INDEX = "part int, doc_id bigint, file string, offset bigint, n_bytes bigint, n_ids bigint, ids_before bigint"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_ADD) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview) -> memoryview:
    """The payload of one framed record; a wrong length or checksum raises ``ValueError``."""
    length, check = struct.unpack_from(HEAD, data)
    if check != masked(bytes(data[:8])) or length + HEAD_BYTES + 4 != len(data):
        raise ValueError("the length of a record is damaged")
    payload = data[HEAD_BYTES:-4]
    if struct.unpack("<I", data[-4:])[0] != masked(payload):
        raise ValueError("the payload of a record is damaged")
    return payload


def file_system(uri: str):
    """File system and path of a folder that executors reach by the same address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(
    df: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", folder: str | None = None,
) -> DataFrame:
    """Encode and write every text under ``folder`` (by default a new one in the shared folder); gives the index."""
    folder = folder or scratch_path(df.sparkSession, "records")
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), text_key(F.col(text)).alias("tie"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def task(batches):
        enc = encoder(tokenizer)
        largest = max(enc.tokenizer.get_vocab_size() - 1, end_id)
        width = 2 if largest < 65536 else 4
        end = struct.pack("<I", end_id)
        system, place = file_system(folder)
        system.create_dir(place, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}.ids"
        offset = before = 0
        out = None
        try:
            for batch in batches:
                entries = []
                for doc, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = np.frombuffer(enc.ids(content.as_py() or "") + end, dtype="<u4")
                    payload = struct.pack(PREFIX, width, doc is None, doc or 0) + ids.astype(WIDTHS[width]).tobytes()
                    data = frame(payload)
                    out = out or system.open_output_stream(f"{place}/{name}")
                    out.write(data)
                    entries.append((part, doc, name, offset, len(data), len(ids), before))
                    offset, before = offset + len(data), before + len(ids)
                columns = zip(*entries) if entries else [[]] * len(SCHEMA)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, SCHEMA.types)], schema=SCHEMA)
        finally:
            if out:
                out.close()

    index = measured(placed.mapInArrow(task, INDEX), "index")
    return index.withColumn("file", F.concat(F.lit(folder.rstrip("/") + "/"), "file"))


SCHEMA = pa.schema([
    ("part", pa.int32()), ("doc_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()),
    ("n_bytes", pa.int64()), ("n_ids", pa.int64()), ("ids_before", pa.int64()),
])


def with_start(index: DataFrame) -> DataFrame:
    """Add ``start``: ids of all records before, over all files. One row per file meets in the running sum."""
    files = index.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return index.join(files.select("part", before.alias("_before")), "part").withColumn(
        "start", F.col("_before") + F.col("ids_before")).drop("_before")


def records(entries: list[dict], read_bytes: int = READ_BYTES):
    """(entry, doc_id, ids) of index entries, read from the files in the order given."""
    at, stream, opened = 0, None, None
    while at < len(entries):
        first = entries[at]
        upto, size = at, 0
        while upto < len(entries) and entries[upto]["file"] == first["file"] and (
            entries[upto]["offset"] == first["offset"] + size and (size == 0 or size + entries[upto]["n_bytes"] <= read_bytes)
        ):
            size += entries[upto]["n_bytes"]
            upto += 1
        if opened != first["file"]:
            system, place = file_system(first["file"])
            stream, opened = system.open_input_file(place), first["file"]
        data = memoryview(stream.read_at(size, first["offset"]))
        for e in entries[at:upto]:
            low = e["offset"] - first["offset"]
            payload = unframe(data[low:low + e["n_bytes"]])
            width, missing, doc = struct.unpack_from(PREFIX, payload)
            yield e, None if missing else doc, np.frombuffer(payload[PREFIX_BYTES:], dtype=WIDTHS[width])
        at = upto


def read(index: DataFrame, keep: tuple[str, ...] = (), with_ids: bool = True) -> DataFrame:
    """The records that the rows of ``index`` name: doc_id, n_tokens, ids_crc32, ``keep`` and, if asked for, ids."""
    types = {f.name: f.dataType.simpleString() for f in index.schema.fields}
    schema = ", ".join([*[f"{c} {types[c]}" for c in keep], "doc_id bigint, n_tokens bigint, ids_crc32 bigint",
                        *(["ids array<bigint>"] if with_ids else [])])

    made = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]

    def task(batches):
        for batch in batches:
            entries, out, ids_of = batch.to_pylist(), [], []
            for _, doc, ids in records(entries):
                out.append((doc, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                if with_ids:
                    ids_of.append(ids.astype("int64"))
            columns = zip(*out) if out else [[]] * len(made)
            arrays = [*[batch.column(c) for c in keep], *[pa.array(c, t) for c, (_, t) in zip(columns, made)]]
            names = [*keep, *[n for n, _ in made]]
            if with_ids:
                arrays, names = [*arrays, pa.array(ids_of, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.record_batch(arrays, names=names)

    return index.select("file", "offset", "n_bytes", *keep).mapInArrow(task, schema)
