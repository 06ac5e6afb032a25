import struct
import zlib

import pytest
from pyspark.sql import functions as F

from opinara.llm import records

P = pytest.importorskip("public_tokenizers")


def test_frames_detect_damage():
    data = records.frame(b"payload")
    assert bytes(records.unframe(memoryview(data))) == b"payload"
    for i in range(len(data)):
        with pytest.raises(ValueError):
            records.unframe(memoryview(data[:i] + bytes([data[i] ^ 1]) + data[i + 1:]))
    with pytest.raises(ValueError):
        records.unframe(memoryview(data + b"x"))


def test_round_trip(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    index = records.with_start(records.write(documents, P.path("byte_bpe_50k.json"), 2))
    out = sorted(records.read(index, keep=("start",)).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in out]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    at = 0
    for r in out:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"]))
        at += r["n_tokens"]
    expected = sorted((d["doc_id"] or 0, library.encode(d["text"] or "", add_special_tokens=False).ids + [2]) for d in documents.collect())
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in out) == expected


def test_shuffled_reads(spark, documents):
    index = records.write(documents, P.path("byte_bpe_50k.json"), 2)
    some = index.where(F.col("doc_id") % 2 == 1).repartition(3, F.col("doc_id"))
    assert sorted(r["doc_id"] for r in records.read(some).collect()) == [1, 3, 5, 5, 7, 7, 9]


def test_empty(no_documents):
    index = records.write(no_documents, P.path("byte_bpe_50k.json"), 2)
    assert records.read(records.with_start(index), keep=("start",)).collect() == []


def test_large_ids_beside_nulls_stay_exact(spark):
    ids = [2**60 + 1, None, 2**60 + 3, -(2**62) - 1]
    docs = spark.createDataFrame([(i, "one two three") for i in ids], "doc_id bigint, text string").coalesce(1)
    index = records.with_start(records.write(docs, P.path("byte_bpe_50k.json"), 2))
    assert sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in records.read(index, keep=("start",)).collect())
    assert sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in records.read(index.coalesce(1), with_ids=False).collect())
