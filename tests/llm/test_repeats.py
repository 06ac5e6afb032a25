import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from opinara.llm import repeats


def brute(rows, length, keep_first):
    at = defaultdict(list)
    data = [(t or "").encode() for _, t in rows]
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0)):
        for p in range(len(data[i]) - length + 1):
            at[data[i][p:p + length]].append((i, p))
    covered = [bytearray(len(d)) for d in data]
    for places in at.values():
        if len(places) > 1:
            for i, p in places[1:] if keep_first else places:
                covered[i][p:p + length] = b"\1" * length
    out = []
    for (doc, _), d, c in zip(rows, data, covered):
        runs = sum(c[j] and not (j and c[j - 1]) for j in range(len(c)))
        out.append((doc or 0, len(d), sum(c), runs, hashlib.sha256(bytes(b for b, x in zip(d, c) if not x)).hexdigest()))
    return sorted(out)


def texts(make_prose, seed):
    rng = random.Random(seed)
    shared = [make_prose(900 + i, 30) for i in range(4)]
    rows = []
    for i in range(40):
        parts = [make_prose(seed * 1000 + i, rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            low = rng.randrange(len(s) // 2)
            parts += [s[low:low + rng.randrange(20, 200)], make_prose(seed * 77 + i, rng.randrange(5))]
        rows.append((i, rng.choice([" ", "é", "\n"]).join(parts)))
    rows += [(100, "a" * 90), (101, "ab" * 60), (102, "a" * 30), (103, None), (104, ""), (105, "short"), (106, "x" + "ab" * 40)]
    return rows


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("options", [{}, {"group_bytes": 500}, {"owner_runs": 2}])
def test_matches_brute_force(spark, make_prose, keep_first, options):
    rows = texts(make_prose, 3)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = repeats.remove(df, length=40, anchor=12, keep_first=keep_first, **options).collect()
    found = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out)
    assert found == brute(rows, 40, keep_first)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in out)


def test_long_texts_are_cut_into_stretches(spark, make_prose, monkeypatch):
    rows = [(1, make_prose(5, 700)), (2, make_prose(6, 300) + make_prose(5, 700)[500:2500])]
    whole = repeats.runs(np.frombuffer(rows[0][1].encode(), np.uint8), 40, 12)
    monkeypatch.setattr(repeats, "STRETCH", 1 << 10)
    parts = repeats.runs(np.frombuffer(rows[0][1].encode(), np.uint8), 40, 12)
    n = len(rows[0][1].encode()) - 39
    for start, windows in ((whole[2], whole[3]), (parts[2], parts[3])):
        assert sorted(p for a, w in zip(start, windows) for p in range(a, a + w)) == list(range(n))


@pytest.mark.parametrize("length", [8, 11, 40])
def test_longest_previous_factors(length):
    rng = random.Random(length)
    cases = [b"abracadabra-abracadabra-abra" * 3, b"a" * 120, b"\0" * 60 + b"ab\0" * 30, bytes(rng.choice(b"ab") for _ in range(300)),
             bytes(range(100))]
    part = bytes(rng.choice(b"abcd") for _ in range(90))
    cases.append(part + b"x" + part[20:] + b"y" + part[:70])
    for data in cases:
        n = len(data) - length + 1
        # All windows, and some of them only.
        for starts in (list(range(n)), sorted(rng.sample(range(n), n // 2))):
            factor, source = repeats.previous_factors(np.frombuffer(data, np.uint8), np.array(starts), length)
            for i, p in enumerate(starts):
                agreed = [next((k for k in range(length) if data[p + k] != data[q + k]), length) for q in starts[:i]]
                assert factor[i] == max(agreed, default=0)
                assert source[i] == -1 if not factor[i] else source[i] < i and agreed[source[i]] == factor[i]


def test_smaller_neighbours():
    rng = random.Random(1)
    order = rng.sample(range(200), 200)
    before, after = repeats.smaller_neighbours(np.array(order))
    for i, x in enumerate(order):
        assert before[i] == max((j for j in range(i) if order[j] < x), default=-1)
        assert after[i] == min((j for j in range(i + 1, 200) if order[j] < x), default=-1)


def test_odd_rows(documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    out = repeats.remove(documents, keep_first=False, with_bytes=False).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == brute(rows, 200, False)
    assert repeats.remove(no_documents).collect() == []
