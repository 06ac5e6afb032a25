import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

from opinara.llm import packing

P = pytest.importorskip("public_tokenizers")


def check(lengths, sequence, offset, capacity):
    by = defaultdict(list)
    for n, s, o in zip(lengths, sequence, offset):
        by[s].append((o, n))
    for held in by.values():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity, low, high", [(100, 20, 60), (100, 34, 66), (64, 1, 64), (1000, 200, 500)])
def test_no_worse_than_best_fit_and_search_helps(capacity, low, high):
    rng = random.Random(capacity + low)
    lengths = np.array([rng.randint(low, high) for _ in range(400)])
    plain = check(lengths, *packing.pack(lengths, capacity, exchanges=0), capacity)
    better = check(lengths, *packing.pack(lengths, capacity), capacity)
    assert -(-lengths.sum() // capacity) <= better <= plain


def test_exchanges_reach_the_optimum():
    # Best fit, longest first, needs three sequences here; two are enough.
    lengths = np.array([4, 4, 3, 3, 3, 3])
    assert check(lengths, *packing.pack(lengths, 10, exchanges=0), 10) == 3
    assert check(lengths, *packing.pack(lengths, 10), 10) == 2


def test_every_exchange_fills(monkeypatch):
    rng = random.Random(1)
    bins = packing.Bins(100)
    for i in sorted(range(60), key=lambda _: rng.random()):
        bins.add(rng.randint(26, 60), i)
    for _ in range(200):
        open_ = [b for b, f in enumerate(bins.fill) if 0 < f < 100]
        before = sum(f * f for f in bins.fill)
        if not open_ or not packing.exchange(bins, min(open_, key=lambda b: bins.fill[b])):
            break
        assert sum(f * f for f in bins.fill) > before
        assert all(f == sum(n for n, _ in held) <= 100 for f, held in zip(bins.fill, bins.items))


def test_pieces_and_sequences(spark, documents, no_documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    out = packing.packed(packing.pieces(documents, P.path("word_bpe_49k.json"), 1, capacity=512), capacity=512, group_pieces=7).collect()
    check([r["length"] for r in out], [r["sequence_id"] for r in out], [r["offset"] for r in out], 512)
    expected = []
    for r in documents.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for k, low in enumerate(range(0, len(ids), 512)):
            part = ids[low:low + 512]
            expected.append((r["doc_id"], k, low, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32"))) for r in out)
    assert packing.packed(packing.pieces(no_documents, P.path("word_bpe_49k.json"), 1)).collect() == []
    with_ids = packing.pieces(documents, P.path("word_bpe_49k.json"), 1, with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in with_ids)


def test_rows_of_any_kind(spark):
    rows = spark.createDataFrame([(i, 10 + i % 50, "x") for i in range(300)], "id int, n int, offset string")
    out = packing.packed(rows, "n", 100, group_pieces=50).collect()
    assert {r["id"] for r in out} == set(range(300))
    used = check([r["n"] for r in out], [r["sequence_id"] for r in out], [r["offset"] for r in out], 100)
    assert used <= 1.05 * sum(10 + i % 50 for i in range(300)) / 100 + 2


def improving(held, capacity):
    """Any move, one-for-one or two-for-one exchange that makes the sum of squared fills larger, by trying all."""
    fills = [sum(h) for h in held]
    for a, giver in enumerate(held):
        for b, taker in enumerate(held):
            if a != b and fills[b] < capacity:
                backs = [0, *taker, *(x + y for i, x in enumerate(taker) for y in taker[i + 1:])]
                for length in giver:
                    for gain in (length - s for s in backs):
                        if 0 < gain <= capacity - fills[b] and fills[b] + gain > fills[a]:
                            return a, b, length
    return None


@pytest.mark.parametrize("capacity, low, high, n, seed", [
    (1000, 334, 500, 700, 1), (4096, 1200, 2048, 500, 2), (100, 20, 60, 400, 3), (400, 90, 210, 800, 4), (64, 1, 64, 300, 5),
])
def test_search_ends_only_without_exchanges(capacity, low, high, n, seed):
    rng = random.Random(seed)
    lengths = np.array([rng.randint(low, high) for _ in range(n)])
    sequence, offset = packing.pack(lengths, capacity)
    used = check(lengths, sequence, offset, capacity)
    held = defaultdict(list)
    for length, s in zip(lengths.tolist(), sequence):
        held[s].append(length)
    assert used == -(-lengths.sum() // capacity) or improving(list(held.values()), capacity) is None


def test_large_ids_beside_nulls_stay_exact(spark):
    ids = [2**60 + 1, None, 2**60 + 3, -(2**62) - 1]
    docs = spark.createDataFrame([(i, "one two three") for i in ids], "doc_id bigint, text string").coalesce(1)
    out = packing.packed(packing.pieces(docs, P.path("word_bpe_49k.json"), 1)).collect()
    assert sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in out)
    rows = spark.createDataFrame([("a", None, 3), (None, 2**60 + 1, 4)], "id string, big bigint, length int")
    assert sorted((r["id"] or "", r["big"]) for r in packing.packed(rows, capacity=10).collect()) == [("", 2**60 + 1), ("a", None)]
