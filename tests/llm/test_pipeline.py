"""The pipeline on the smallest tables against plain Python, stage by stage."""

import os
import re

import pytest

import corpus_pipeline
from opinara.llm import decontaminate

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs, docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema) if name != "packing" else stage(spark, docs, SF)
        out.append((name, docs, docs.collect()))
    return {name: (df, rows) for name, df, rows in out}


def ids(rows):
    return {r["doc_id"] for r in rows}


def test_columns_and_order(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontaminate", "secrets", "packing"] and corpus_pipeline.ORACLE_SQL is None
    for name in names[:-1]:
        assert stages[name][0].columns == stages["documents"][0].columns


def test_quality(stages):
    from test_rules import bits, brute

    assert ids(stages["quality"][1]) == {r["doc_id"] for r in stages["documents"][1] if bits(brute(r["text"])) == 0}


def test_near_dedup(stages):
    from test_near import brute

    expected = brute([(r["doc_id"], r["text"]) for r in stages["quality"][1]], 5, 80)
    assert ids(stages["near_dedup"][1]) == {d for d, (_, c) in expected.items() if d == c}


def test_decontaminate(stages, spark):
    def words(t):
        return [w for w in re.split(r"[\W_]+", t.lower()) if w]

    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(text):
        own = words(text)
        for item in items:
            w = min(decontaminate.OVERLAP, len(item))
            for p in range(-w, len(own)):
                for q in range(len(item) - w + 1):
                    if sum(0 <= p + k < len(own) and own[p + k] == item[q + k] for k in range(w)) >= decontaminate.SIMILARITY * w:
                        return True
        return False

    gone = [r for r in stages["near_dedup"][1] if r["doc_id"] not in ids(stages["decontaminate"][1])]
    assert gone and all(leaks(r["text"]) for r in gone)
    joined = [" ".join(i) for i in items]
    assert not any(i in " ".join(words(r["text"])) for r in stages["decontaminate"][1] for i in joined)


def test_secrets(stages):
    from test_credentials import brute

    before = sorted(stages["decontaminate"][1], key=lambda r: r["doc_id"])
    after = {r["doc_id"]: r for r in stages["secrets"][1]}
    assert ids(before) == set(after)
    for r, spans in zip(before, brute([(r["doc_id"], r["text"], r["source"]) for r in before])):
        text, runs = r["text"], []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if runs and a < runs[-1][1]:
                runs[-1][1] = max(b, runs[-1][1])
            else:
                runs.append([a, b])
        for a, b in reversed(runs):
            text = text[:a] + "[secret]" + text[b:]
        assert after[r["doc_id"]]["text"] == text
        assert after[r["doc_id"]]["n_chars"] == (len(text) if spans else r["n_chars"])


def test_packing(stages):
    from test_packing import check

    rows = stages["packing"][1]
    assert ids(rows) == ids(stages["secrets"][1])
    used = check([r["length"] for r in rows], [r["sequence_id"] for r in rows], [r["offset"] for r in rows], 4096)
    assert used <= -(-sum(r["length"] for r in rows) // 4096) + 1
