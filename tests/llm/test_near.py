import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.llm import near


def brute(rows, size, similarity):
    sets = {}
    for doc, text in rows:
        tokens = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            tokens = tokens.replace(c, " ")
        tokens = [w for w in tokens.split(" ") if w]
        sets[doc] = {tuple(tokens[i:i + size]) for i in range(len(tokens) - size + 1)} if len(tokens) >= size else ({tuple(tokens)} if tokens else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def edited(text, rng, share):
    return " ".join(f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


@pytest.mark.parametrize("size", [2, 5])
def test_components_match_brute_force(spark, make_prose, size):
    rng = random.Random(size)
    rows = []
    for family in range(12):
        text = make_prose(family + 500, rng.choice([3, 6, 12, 40, 150, 400]))
        for _ in range(rng.choice([1, 2, 6, 12])):
            rows.append((len(rows), text))
            # Chains of edits, so that only neighbours are similar.
            text = edited(text, rng, 0.4 / (size * 10))
            if rng.random() < 0.3:
                text = text.upper()
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " \n", "one", "ONE", "one two", "ÄÖ x", "äö x", "a b a b a b", "a b a"])]
    rng.shuffle(rows)
    out = near.link(spark.createDataFrame(rows, "doc_id bigint, text string"), size=size).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute(rows, size, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_star_loses_no_link(spark, make_prose):
    """The smallest member of a bucket is similar to none of two others, which are similar to each other."""
    base = [f"w{i}" for i in range(200)]
    far = " ".join(base[:120] + [f"x{i}" for i in range(80)])
    one, two = " ".join(base), " ".join(base[:195] + [f"y{i}" for i in range(5)])
    rows = [(0, far), (1, one), (2, two)]
    out = near.link(spark.createDataFrame(rows, "doc_id bigint, text string"), size=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {0: 0, 1: 1, 2: 1}


def test_large_star_is_dealt_to_parts(spark, make_prose, monkeypatch):
    monkeypatch.setattr(near, "STAR_PART", 3)
    rng = random.Random(3)
    text = make_prose(77, 300)
    rows = [(0, text)] + [(i, edited(text, rng, 0.01)) for i in range(1, 30)]
    out = near.link(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {d: c for d, (_, c) in brute(rows, 5, 80).items()}


def test_components_of_a_long_chain(spark):
    links = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in near.components(links).collect()} == {0}


def test_recall_of_buckets():
    """Sets of similarity 0.8 share a bucket, whatever their size."""
    rng = np.random.default_rng(5)
    missed = 0
    for i in range(600):
        common = int(rng.choice([4, 8, 40, 400]))
        own = common // 8
        draw = np.unique(rng.integers(0, 2**63, common + 2 * own, dtype=np.int64)).astype(np.uint64) * np.uint64(2)
        rng.shuffle(draw)
        a, b = np.sort(draw[:common + own]), np.sort(np.concatenate((draw[:common], draw[common + own:])))
        missed += not (near.bands(near.signature(a)) == near.bands(near.signature(b))).any()
    assert missed == 0


def test_odd_rows(documents, no_documents):
    out = near.link(documents).collect()
    assert len(out) == documents.count()
    assert all(r["component_id"] is None and r["kept"] for r in out if r["doc_id"] is None)
    assert {(r["doc_id"], r["component_id"]) for r in out if r["doc_id"] in (1, 6, 5, 8)} == {(1, 1), (6, 1), (5, 5), (8, 5)}
    assert near.link(no_documents).collect() == []


def test_deduplicated_keeps_one_of_each_group(documents):
    kept = near.deduplicated(documents)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 3, 4, 5, 7, 9, 10]
    assert sum(r["doc_id"] is None for r in kept.collect()) == 2


@pytest.mark.parametrize("block", [1, 2, 250])
def test_blocks_find_what_stars_miss(spark, make_prose, monkeypatch, block):
    """A family around a text that is no document itself: similar in chains, not to one centre."""
    monkeypatch.setattr(near, "BLOCK", block)
    rng = random.Random(block)
    base = make_prose(4242, 150)
    rows = [(i, edited(base, rng, rng.choice([0.02, 0.05, 0.07, 0.09]))) for i in range(60)]
    out = near.link(spark.createDataFrame(rows, "doc_id bigint, text string"), size=2).collect()
    expected = brute(rows, 2, 80)
    assert len({c for _, c in expected.values()}) > 3
    assert {r["doc_id"]: r["component_id"] for r in out} == {d: c for d, (_, c) in expected.items()}


def test_blocks_emit_no_more_links_than_they_need():
    rows = [(i, i, 0, "a b c d e f g h i j") for i in range(50)]
    assert len(near.compare(rows, 2, 80)) == 49
