import re

import pytest

from opinara.llm import licenses

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
MIT = next(t.text for t in licenses.NOTICES if t.label == "mit")


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


CASES = [
    "MIT License; the mit-license. apache\nlicense", "cc by cc by cc", "gnu general gnu general public license", "mité license", "CC-BY 4.0",
    "GNU General Public License" * 2, "", None, "license mit license license", "Äpache license über mit  LICENSE", "mit",
]


def test_base_matches_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "doc_id bigint, text string")
    out = licenses.scan(df).orderBy("doc_id").collect()
    for t, r in zip(CASES, out):
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def test_notices_tolerate_changes_but_not_in_key_phrases(spark):
    changed = MIT.replace("software", "program").replace("hereby", "now")
    broken = MIT.replace("obtaining a copy", "obtaining one copy")
    df = spark.createDataFrame([(1, f"x y {MIT} z"), (2, changed), (3, broken), (4, MIT[:40])], "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert out[1]["labels"] == "mit" and out[1]["score"] == 1.0 and out[1]["n_base"] == 0
    assert out[2]["labels"] == "mit" and 0.8 <= out[2]["score"] < 1
    assert out[3]["labels"] == "" and out[4]["labels"] == ""


def test_words_looked_up_follow_the_corpus_and_the_file():
    notice = licenses.Template("n", "a b c d e f g h i j", least=0.8)
    index = licenses.Index((*licenses.BASE, notice), {b"a": 9, b"b": 8, b"c": 1, b"j": 5, b"license": 50, b"mit": 2})
    # Ten words held, eight must agree: the four rarest places, and two of them have to meet.
    assert index.lookups(list(b"a b c d e f g h i j".split())) == {4: [3, 4, 5, 6]}
    # Without d and e there are eight words, so the two of highest IDF are enough; without three the notice is not there.
    assert index.lookups(b"a b c f g h i j".split()) == {4: [5, 6]}
    assert index.lookups(b"a b c f g h i".split()) == {}
    assert index.lookups(b"license the mit".split()) == {3: [0, 1]}
    with pytest.raises(ValueError):
        licenses.Index((licenses.Template("x", "--"),), {})


def test_odd_rows(documents, no_documents):
    out = licenses.scan(documents).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_base"]) for r in out) == sorted(
        (r["doc_id"] or 0, *brute(r["text"])[:2]) for r in documents.collect())
    assert licenses.scan(no_documents).collect() == []


def slow_in_order(own, found, start, shift):
    """The longest common subsequence over all pairs that are near enough, as a plain table."""
    best = [[0] * (len(found) + 1) for _ in range(len(own) + 1)]
    for p, w in enumerate(own):
        for i, x in enumerate(found):
            pair = w == x and abs(i - p - start) <= shift
            best[p + 1][i + 1] = max(best[p][i] + pair, best[p][i + 1], best[p + 1][i])
    return best[-1][-1]


def slow_matches(templates, found):
    out = set()
    for n, t in enumerate(templates):
        own = licenses.words(t.text)
        for start in range(-len(own) - t.shift, len(found) + t.shift + 1):
            whole = all(
                any(found[i:i + len(key)] == key and abs(i - at - start) <= t.shift for i in range(len(found)))
                for key in map(licenses.words, t.keys) for at in [next(i for i in range(len(own)) if own[i:i + len(key)] == key)])
            if whole and (share := slow_in_order(own, found, start, t.shift) / len(own)) >= t.least:
                out.add((n, start, share))
    return out


def edited(rng, own, fixed, edits):
    """Words replaced, inserted and left out, none of them inside the stretches of ``fixed``."""
    free = [i for i in range(len(own)) if not any(a <= i < b for a, b in fixed)]
    kinds = {i: rng.choice(["replace", "insert", "cut"]) for i in rng.sample(free, min(edits, len(free)))}
    out = []
    for i, w in enumerate(own):
        kind = kinds.get(i)
        out += {"replace": [b"other"], "insert": [b"more", w], "cut": []}.get(kind, [w])
    return out


def test_every_notice_with_words_replaced_inserted_and_cut():
    import random

    rng = random.Random(3)
    loose = licenses.Template("loose", " ".join(f"v{i}" for i in range(20)))
    some = [t for t in licenses.TEMPLATES if t.label in ("gpl", "cc-by", "mit", "unlicense", "mpl")]
    templates = (*some, loose, licenses.Template("repeats", "a a b b c c d d e e"), licenses.Template("one", "solo"))
    own = [licenses.words(t.text) for t in templates]
    frequency = {w: rng.choice([0, 1, 5, 50]) for o in own for w in o}
    index = licenses.Index(templates, frequency)
    matched = 0
    for _ in range(150):
        n = rng.randrange(len(own))
        found = [b"pad"] * rng.randrange(4) + edited(rng, own[n], [], rng.randrange(6)) + [b"a"] * rng.randrange(4)
        expected, got = slow_matches(templates, found), index.matches(found)
        assert len(got) == len(set(got)) and set(got) == expected
        matched += any(m == n for m, _, _ in expected)
    assert matched > 50


def test_recall_of_changed_notices():
    import random

    rng = random.Random(9)
    index = licenses.Index(licenses.TEMPLATES, {})
    asked = labelled = 0
    for n, (t, own) in enumerate(index.templates):
        if t.least < 1:
            for edits in (1, 2):
                for _ in range(40):
                    found = [b"x", b"y"] * rng.randrange(2) + edited(rng, own, index.keys[n], edits) + [b"z"] * rng.randrange(2)
                    asked += 1
                    labelled += t.label in index.judge(b" ".join(found).decode())[5].split(",")
    assert labelled >= 0.9 * asked > 1000


def test_inserted_and_missing_words_and_versions():
    index = licenses.Index(licenses.TEMPLATES, {})
    bsd = next(t.text for t in licenses.NOTICES if t.label == "bsd")
    lesser = ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
              "the Free Software Foundation")
    three = ("the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or "
             "(at your option) any later version")
    boost = next(t.text for t in licenses.NOTICES if t.label == "boost")
    cases = {
        bsd.replace("are permitted", "are hereby permitted"): "bsd", bsd.split(" ", 1)[1]: "bsd", lesser: "lgpl", three: "gpl,gpl-3",
        boost: "boost", "Licensed under the Apache License, Version 2.0.": "apache,apache-2.0", "CC BY-NC 4.0": "cc-by,cc-by-nc",
        bsd.replace("source and binary", "source or binary"): "", "free and open source software for the public": "",
    }
    for text, labels in cases.items():
        assert index.judge(text)[5] == labels, text
