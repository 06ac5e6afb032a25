import re
from collections import Counter

from opinara.llm import rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def bits(m):
    return sum(1 << i for i, fails in enumerate([
        m["n_words"] < 10, 100 * m["n_repeat_words"] > 20 * m["n_words"], 10 * m["n_symbols"] > m["n_words"],
        m["word_chars"] > 40 * m["n_words"], 2 * m["n_dup_lines"] > m["n_lines"],
    ]) if fails)


def test_measurements_match_brute_force(documents):
    rows = rules.ledger(documents).collect()
    assert len(rows) == documents.count()
    for r in rows:
        expected = brute(r["text"])
        assert {k: r[k] for k in expected} == expected
        assert r["failure_bits"] == bits(expected)


def test_overlapping_repeats_and_symbols(spark):
    texts = ["a b c d e a b c d e f", "x " * 12, "a b c d e f g h", "p q r s t u p q r s t v", "#a *b $c %d &e |f <g >h i j k l", "w" * 500]
    rows = rules.ledger(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    for r in rows:
        assert {k: r[k] for k in brute("")} == brute(r["text"])


def test_policies_judge_stored_bits(documents):
    entries = rules.ledger(documents)
    base = {r["failure_bits"]: r["kept"] for r in rules.judged(entries, rules.POLICIES["base"]).collect()}
    assert all(kept == (not b & 3) for b, kept in base.items())
    judged = rules.judged(entries, rules.POLICIES["1"]).where("kept").select("failure_bits", "policy").collect()
    assert judged and all(r["failure_bits"] == 0 and r["policy"] == "1" for r in judged)


def test_ablations(documents):
    policy = rules.POLICIES["1"]
    entries = rules.ledger(documents)
    found = {r["rule"]: r for r in rules.ablations(entries, policy).collect()}
    stored = [r["failure_bits"] & rules.mask(policy.reject) for r in entries.collect()]
    assert set(found) == set(policy.reject)
    for name, r in found.items():
        bit = rules.mask((name,))
        assert r["n_failing"] == sum(bool(b & bit) for b in stored)
        assert r["n_only"] == sum(b == bit for b in stored)
        assert r["n_kept"] == sum(b == 0 for b in stored) and r["n_kept_without"] == r["n_kept"] + r["n_only"]


def test_empty_table(no_documents):
    assert rules.ledger(no_documents).collect() == []
    assert rules.ablations(rules.ledger(no_documents), rules.POLICIES["1"]).collect() == []
