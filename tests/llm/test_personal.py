import random
import re
from hashlib import sha256
from math import exp, log

import pytest
from pyspark.sql import functions as F

from opinara.llm import personal
from opinara.llm.queries import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def passes_luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    """(kind, start, end) by kind, then start, without any of the library's code."""
    out = []
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None,
                    "card": 16 <= len(d) <= 19 and passes_luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


ODD = [
    "a@b.c@d.e.f", "a@b.c_d@e.f", "x@y", "x@y.", "..@..", "%@-.-", "é@ü.de a.b@ü.com", "a@b.c.@d.e", "me@host.example.com,you@host.example.org",
    "1.2.3.4.5.6.7.8", "1.2.3", "256.1.1.1", "0255.000.1.00001", "300.1.1.1.1", "1..2.3.4.5", "999999999999.1.1.1", "1.2.3.4", "01.02.03.256",
    "4111111111111111", "4111-1111-1111-1111", "4111 1111 1111 1111", "4111  1111 1111 1111", "4111111111111112", "a4111111111111111b", "6011000990139424 5", "0000000000000000000", "00000000000000000000",
    "+1 (555) 123-4567", "+1234567", "+12345678", "+1 2", "+1", "++1 555 123 4567", "+1 555 123 4567 ... ", "+49 30 1234567890123456", "call +1-555-0100-200. Or",
    "日本 a@b.co 👍 +1 555 010 0200 👍👍 10.0.0.1", "1" * 4000, "1.1" * 2000, "a" * 3000 + "@", "+" * 500 + "1" * 8, "1 " * 3000, "a.a" * 1000 + "@x.y", "(at)", "", None,
]


def test_base_kinds_on_odd_texts(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id bigint, text string")
    for r in personal.scan(df).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] == base_spans(r["text"]), r["text"]


def test_base_kinds_on_random_texts(spark):
    rng = random.Random(5)
    pieces = ["@", ".", "+", "1", "23", "255", "256", "-", " ", "(", ")", "a", "b.c", "4111111111111111", "é", "\n", "0"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in personal.scan(df).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] == base_spans(r["text"]), r["text"]


def digest(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_query_against_plain_python(spark, tmp_path):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["word", "a@b.de", "10.1.2.3", "10.1.2.300", "4111111111111111", "+1 555 010 0200", "7"]) for _ in range(12)) for _ in range(150)]
    rows = [*enumerate(texts), (1, texts[1]), (None, texts[2]), (None, None), (200, ""), (201, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["op11_personal"](spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    expected = []
    for i, t in rows:
        base = base_spans(t)
        expected.append((i, *[sum(k == kind for k, _, _ in base) for kind in ("email", "ip", "card", "phone")], sha256(digest(base).encode()).hexdigest()))
    assert sorted(map(str, expected)) == sorted(str((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"])) for r in out)
    for r in out:
        assert set(digest(base_spans(dict(rows).get(r["doc_id"]))).split(",")) <= {*r["spans"].split(","), ""} or r["doc_id"] in (1, None)


def contacts(n, seed=7):
    """Texts in which numbers after a word for phones are phones, with a plus or without, and numbers of orders are not."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        number = f"{rng.randrange(200, 999)} {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}"
        form = rng.random()
        if form < 0.5:
            rows.append((i, f"please call +1 {number} today", "phone"))
        elif form < 0.505:
            rows.append((i, f"please call 1 {number} today", "loose"))
        else:
            rows.append((i, f"your order {number} is on its way", "order"))
    return rows


def test_look_alikes_of_verified_data_are_reported(spark):
    rows = contacts(1500)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, form string")
    found = {(r["doc_id"], r["form"]): r["spans"] for r in personal.scan(df).collect()}
    for (i, form), spans in found.items():
        text = rows[i][1]
        if form == "phone":
            assert [(s["kind"], s["base"]) for s in spans] == [("phone", True)]
        elif form == "loose":
            assert [text[s["start"]:s["end"]] for s in spans] == [text[len("please call "):-len(" today")]]
            assert [(s["base"], 0 < s["score"] < 1) for s in spans] == [(False, True)]
        else:
            assert spans == []


def test_runs_report_one_span_each(spark):
    rows = [(1, 7, 0, 10, 5, False), (1, 7, 5, 12, 4, False), (1, 7, 11, 20, 5, False), (1, 7, 20, 25, 5, False), (2, 7, 0, 5, 0, True), (2, 7, 2, 9, 5, False)]
    found = spark.createDataFrame(rows, "_id int, _key int, start int, end int, place int, sure boolean")
    found = found.select("*", *[F.lit(1).alias(f) for f in personal.FEATURES])
    runs = personal.in_runs(found.unionByName(found)).collect()
    assert sorted((r["_id"], r["start"], r["run"], r["verified"]) for r in runs) == [
        (1, 0, 1, False), (1, 5, 1, False), (1, 11, 1, False), (1, 20, 2, False), (2, 0, 1, True), (2, 2, 1, True)]
    model = personal.Model(0.0, (), (0.4,) * len(personal.GENERATORS))
    out = personal.chosen(personal.in_runs(found), model).collect()
    assert sorted((r["_id"], r["start"], r["end"], r["base"]) for r in out) == [(1, 0, 10, False), (1, 20, 25, False), (2, 0, 5, True)]


def boosted_by_rows(rows, rounds, depth):
    """Scores by the same rules on single rows, all sums taken anew for every split."""
    pos = sum(y for _, y in rows)
    margins = [log(pos / (len(rows) - pos))] * len(rows)
    for _ in range(rounds):
        graded = [(x, y - 1 / (1 + exp(-m)), (p := 1 / (1 + exp(-m))) * (1 - p)) for (x, y), m in zip(rows, margins)]

        def leaves(at, left):
            def worth(some):
                return sum(graded[i][1] for i in some) ** 2 / (sum(graded[i][2] for i in some) + personal.SMOOTH)

            best, parts = 1e-6, None
            for f in personal.FEATURES if left else ():
                for bound in sorted({graded[i][0][f] for i in at})[:-1]:
                    low, high = [i for i in at if graded[i][0][f] <= bound], [i for i in at if graded[i][0][f] > bound]
                    gain = worth(low) + worth(high) - worth(at)
                    if gain > best * (1 + 1e-9):
                        best, parts = gain, (low, high)
            if parts:
                return leaves(parts[0], left - 1) | leaves(parts[1], left - 1)
            value = personal.RATE * sum(graded[i][1] for i in at) / (sum(graded[i][2] for i in at) + personal.SMOOTH)
            return {i: value for i in at}

        step = leaves(list(range(len(rows))), depth)
        margins = [m + step[i] for i, m in enumerate(margins)]
    return [1 / (1 + exp(-m)) for m in margins]


def test_trees_against_boosting_row_by_row(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(120):
        x = {f: rng.randrange(4) for f in personal.FEATURES}
        rows.append((x, int(rng.random() < (0.9 if x["digits"] > 1 and x["cue"] != 2 else 0.2 + 0.1 * x["left"]))))
    table = spark.createDataFrame([(*x.values(), y, False, 7) for x, y in rows], ", ".join(f"{f} int" for f in personal.FEATURES) + ", verified int, sure boolean, _key bigint")
    model = personal.boosted(personal.counted(table.withColumn("verified", F.col("verified") == 1)), rounds=4, depth=2)
    scores = [r["s"] for r in table.select("*", model.score().alias("s")).collect()]
    assert len(model.trees) == 4 and scores == pytest.approx(boosted_by_rows(rows, 4, 2), abs=1e-9)


def test_thresholds_are_the_lowest_that_hold(spark):
    # (generator, digits, n, pos): a model that scores by digits alone
    cells = [(0, 5, 50, 50), (0, 4, 50, 48), (0, 3, 50, 20), (1, 5, 40, 10), (2, 5, 3, 0)]
    rows = spark.createDataFrame([(g, d, n, p) for g, d, n, p in cells], "generator int, digits int, n long, pos long")
    rows = rows.select("*", *[F.lit(0).alias(f) for f in personal.FEATURES if f not in ("generator", "digits")])
    tree = ("digits", 3, 0.0, ("digits", 4, 2.0, 4.0))
    model = personal.calibrated(rows, personal.Model(0.0, (tree,)), precision=0.95, least=30)
    assert model.thresholds[:3] == (0.88, None, None)


def test_defined_cases(spark, documents, no_documents):
    out = personal.scan(documents).collect()
    assert len(out) == documents.count() and all(isinstance(r["n_words"], str) and r["spans"] is not None for r in out)
    assert personal.scan(no_documents).collect() == []
    same = spark.createDataFrame([(1, "a@b.de"), (1, "a@b.de"), (None, "a@b.de"), (2, None)], "doc_id bigint, text string")
    assert sorted(r["n_spans"] for r in personal.scan(same).collect()) == [0, 1, 1, 1]
    assert personal.fit(personal.in_runs(personal.candidates(same, "doc_id", "text"))) is None
